"""Reports on sets of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, quoted_token


def listed_names(texts: DataFrame, column: str, prefix: str = "TECH.") -> DataFrame:
    """name: the distinct quoted names that open a line of the texts."""
    line = texts.select(F.explode(lines(F.col(column))).alias("line"))
    return line.select(quoted_token(F.col("line"), prefix).alias("name")).where("name is not null").distinct()


def missing_names(found: DataFrame, listed: DataFrame) -> DataFrame:
    """name: found but not listed, in byte order."""
    return found.select("name").distinct().join(listed.select("name"), "name", "left_anti").orderBy("name")


#: The texts of the report.
REPORT = "=== Tech 比较报告 ===\n\n解析出的Tech数量: %d\nWiki页面中的Tech数量: %d\n解析中有但Wiki中没有的Tech数量: %d\n\n"
EXTRA, ALL_PRESENT = "解析中有但Wiki中没有的Tech:\n", "所有解析出的Tech都存在于Wiki页面中。\n"


def report_text(found: DataFrame, listed: DataFrame) -> DataFrame:
    """One row, `report`: the counts, then the names that are not listed, or that there are none."""
    names = missing_names(found, listed).agg(F.sort_array(F.collect_list("name")).alias("names"))
    row = set_report(found, listed).crossJoin(names)  # one row each
    lines_ = F.array_join(F.transform("names", lambda n: F.concat(F.lit("  - "), n, F.lit("\n"))), "")
    rest = F.when(F.col("has_extra"), F.concat(F.lit(EXTRA), lines_)).otherwise(ALL_PRESENT)
    return row.select(F.concat(F.format_string(REPORT, "n_found", "n_listed", "n_extra"), rest).alias("report"))


def set_report(found: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: the sizes of both sets and of the difference, and whether there is one."""
    both = found.select("name").distinct().withColumn("f", F.lit(1)).join(listed.select("name").distinct().withColumn("l", F.lit(1)), "name", "full")
    extra = F.count_if(F.col("l").isNull())
    return both.agg(F.count("f").alias("n_found"), F.count("l").alias("n_listed"), extra.alias("n_extra"), (extra > 0).alias("has_extra"))
