"""What has changed between two tables or two texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, show_change, show_value, trim_space

ADDED, DELETED, MODIFIED = "added", "deleted", "modified"


_NO_CHANGES = "array<struct<field:string,old:string,new:string>>"
#: Copies that one generator makes of a row.
_COPIES = 1 << 16


def keyed_diff(new: DataFrame, old: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """key, status and changes (field, old, new as text) of all rows that differ.

    Keys that are only new or only old are added or deleted, each as often as it stands there.
    Of several old rows with a key, the first is compared. Null keys match null keys. One join: of
    the old side only a key's first row and its number of rows are shuffled."""
    columns = [c for c in new.columns if c not in (key, pos)]
    row = F.struct(*(c for c in old.columns if c != key))
    o = old.groupBy(key).agg(F.min_by(row, F.col(pos)).alias("r"), F.count("*").alias("times"))
    n = new.withColumn("_here", F.lit(True))
    met = n.alias("n").join(o.alias("o"), F.col(f"n.{key}").eqNullSafe(F.col(f"o.{key}")), "full")

    def change(c: str) -> Column:
        now = F.col(f"n.{c}")
        before = F.col(f"o.r.{c}") if c in old.columns else F.lit(None)
        differs = ~now.eqNullSafe(before) if c in old.columns else now.isNotNull()
        return F.when(differs, F.struct(F.lit(c).alias("field"), before.cast("string").alias("old"), now.cast("string").alias("new")))

    none = F.array().cast(_NO_CHANGES)
    changes = F.filter(F.array(*map(change, columns)), lambda c: c.isNotNull()) if columns else none
    is_new, is_old = F.col("o.times").isNull(), F.col("n._here").isNull()
    status = F.when(is_old, DELETED).when(is_new, ADDED).otherwise(MODIFIED)
    seen = met.select(F.when(is_old, F.col(f"o.{key}")).otherwise(F.col(f"n.{key}")).alias(key), status.alias("status"), F.when(is_old | is_new, none).otherwise(changes).alias("changes"), F.when(is_old, F.col("o.times")).otherwise(1).alias("times"))
    seen = seen.where((F.col("status") != MODIFIED) | (F.size("changes") > 0))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / _COPIES).cast("long"))
    dealt = seen.withColumn("block", F.explode(blocks))
    here = F.least(F.lit(_COPIES).cast("long"), F.col("times") - F.col("block") * _COPIES)
    return dealt.select(key, "status", "changes", F.explode(F.sequence(F.lit(1).cast("long"), here))).select(key, "status", "changes")


def changes_long(diff: DataFrame, key: str) -> DataFrame:
    """One row for each changed cell."""
    return diff.where(F.col("status") == MODIFIED).select(key, F.inline("changes"))


def diff_summary(diff: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """One row of counts."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (ADDED, DELETED, MODIFIED)]
    return diff.agg(*counts).crossJoin(new.agg(F.count("*").alias("total_new"))).crossJoin(old.agg(F.count("*").alias("total_historical")))  # one row each


#: The texts of reports.
SUMMARY = "数据比较报告:\n  新增: %d 条\n  删除: %d 条\n  修改: %d 条\n  新数据总数: %d 条\n  历史数据总数: %d 条"
SECTIONS = {ADDED: ("新增记录:", "  + "), DELETED: ("删除记录:", "  - "), MODIFIED: ("修改记录:", "  * ")}


def summary_text(row: DataFrame) -> DataFrame:
    return row.select(F.format_string(SUMMARY, ADDED, DELETED, MODIFIED, "total_new", "total_historical").alias("report"))


def detailed_report(diff: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """One row, `report`: the summary, then a section of lines for each status that occurs, in the keys' order.

    The report is published as one text, so its lines are collected in one row."""
    named = show_value(F.col(key))
    change = F.transform("changes", lambda c: F.concat(F.lit("      "), show_change(c["field"], c["old"], c["new"]), F.lit("\n")))
    sign = F.when(F.col("status") == ADDED, SECTIONS[ADDED][1]).when(F.col("status") == DELETED, SECTIONS[DELETED][1]).otherwise(SECTIONS[MODIFIED][1])
    line = F.concat(sign, named, F.when(F.col("status") == MODIFIED, F.lit(":")).otherwise(F.lit("")), F.lit("\n"), F.array_join(change, ""))
    listed = [F.sort_array(F.collect_list(F.when(F.col("status") == s, F.struct(F.col(key).alias("k"), line.alias("line"))))).alias(s) for s in SECTIONS]
    texts = [F.when(F.size(f"l.{s}") > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(f"l.{s}", lambda r: r["line"]), ""), F.lit("" if s == MODIFIED else "\n"))).otherwise("") for s, (head, _) in SECTIONS.items()]
    lists = diff.agg(*listed)
    return summary_text(summary).alias("s").crossJoin(lists.alias("l")).select(F.concat("s.report", F.lit("\n\n"), *texts).alias("report"))  # one row each


def report_lines(diff: DataFrame, key: str) -> DataFrame:
    """section, line: what a detailed report says of each key, to be ordered by both."""
    named = show_value(F.col(key))
    change = F.transform("changes", lambda c: show_change(c["field"], c["old"], c["new"]))
    line = F.when(F.col("status") == MODIFIED, F.concat(named, F.lit(": "), F.array_join(change, "; "))).otherwise(named)
    return diff.select(F.col("status").alias("section"), line.alias("line"))


def line_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, line, status of each line of two texts, compared by place after trimming; an added line is changed.

    Both texts stand in one row, so their lines are zipped there and nothing is shuffled."""
    none = F.array().cast("array<string>")
    zipped = F.arrays_zip(F.coalesce(lines(F.col(old)), none).alias("o"), F.coalesce(lines(F.col(new)), none).alias("n"))
    met = pairs.select(key, F.posexplode(zipped).alias("line", "t"))
    return met.select(key, F.col("line").cast("long").alias("line"), _line_status(F.col("t.o"), F.col("t.n")).alias("status"))


def _line_status(old: Column, new: Column) -> Column:
    return F.when(new.isNull(), "removed").when(trim_space(old) == trim_space(new), "unchanged").otherwise("changed")


def line_diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "changed", "removed")))


def content_changed(old: Column, new: Column, json: bool = False) -> Column:
    """Whether a write is due; JSON is compared by value, whatever its spacing and the order of members.

    Contents that are no JSON are compared as texts."""
    if not json:
        return ~old.eqNullSafe(new)

    def value(text: Column) -> Column:
        return F.coalesce(F.to_json(F.try_parse_json(trim_space(text))), trim_space(text))

    return ~value(old).eqNullSafe(value(new))
