"""URL filters by hashed expressions.

A rule is a host and a path, written together as in `example.net/en/`. A URL is expanded into
the suffixes of its host, by labels, times the prefixes of its path that end in a slash, and
the empty one. A rule stands under one such expression: its host and its path up to the last
slash. Both sides meet on the first PREFIX hex digits of the expression's SHA-256; then the
whole digests must agree, and the URL's path must start with the rule's whole path. Of the
rules that fit, the longest wins; of two equal ones, block.

Expressions with more labels or slashes than any rule has are not made, as they fit none.
A rule set of up to BROADCAST_RULES is broadcast; a larger one is joined by shuffle, with
its rows in SALTS copies, so that the expressions of a common host spread.

Null URLs and URLs without `://` have an empty host and path, which fit no rule. Where no rule
fits, rule is null and the verdict is the default. Repeated rows stay, each judged for itself.
No pages give no rows. A very long
path has as many expressions as the deepest rule has slashes, at most. Rules with a null host or path are ignored. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stash

PREFIX, BROADCAST_RULES, SALTS, DEFAULT = 8, 100_000, 16, "allow"
#: Verdict, host and path of the rules that the query applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """Behind the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Behind the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, most_labels: Column | int, most_slashes: Column | int) -> Column:
    """Host suffixes of up to so many labels, times path prefixes of up to so many slashes."""
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(most_slashes))), lambda k: F.when(k == 0, "").otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))


def _slashes(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    rules = rules.where("host is not null and path is not null").select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    size = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(_slashes(F.col("rule_path"))).alias("slashes")).first()
    last = F.when(F.col("rule_path").contains("/"), F.regexp_extract("rule_path", r"(?s)\A(.*/)", 1)).otherwise("")
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), last), 256)
    keyed = rules.select("rule_host", "rule_path", "rule_verdict", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("short"))

    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = stash(parts.withColumn("row", F.monotonically_increasing_id()))
    made = F.explode(_expressions(F.col("host"), F.col("path"), size.labels or 0, size.slashes or 0))
    digests = parts.where("host <> ''").select("row", "path", made.alias("e")).select("row", "path", F.sha2("e", 256).alias("digest"))
    digests = digests.withColumn("short", F.substring("digest", 1, PREFIX))
    if size.n <= BROADCAST_RULES:
        met = digests.join(F.broadcast(keyed), "short")
    else:
        salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = digests.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    fits = met.where(F.col("digest").eqNullSafe(F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.col("rule_verdict") == "block", F.concat("rule_host", "rule_path"))
    best = fits.groupBy("row").agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), rank).alias("r"))
    return parts.join(best, "row", "left").select(
        "page_id", "host", "path", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.coalesce("r.rule_verdict", F.lit(default)).alias("verdict")
    )


#: The query's rules and results in DuckDB SQL.
ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
judged AS (
  SELECT page_id, host, path,
         (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules
          WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule
  FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT any_value(verdict) FROM rules WHERE rhost || rpath = rule), 'allow') AS verdict FROM judged
"""
