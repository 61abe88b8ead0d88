"""All registered queries of the library proper, each with the DuckDB SQL that it must equal.

New and historical tables are made of `orders`: history lacks each tenth key, has other prices
and blank priorities in places, and some keys of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diff, lookup, merge, sets
from ..operators.mapping import KEEP_FILLED, OVERWRITE, PREFER_NEW, PREFER_OLD, PRESERVE, TableBuilder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_CELLS = "o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderpriority AS prio, o_orderstatus AS st"
_NEW = f"n AS (SELECT {_CELLS}, o_orderkey AS pos FROM orders)"
_OLD = f"""h AS (SELECT k, CASE WHEN k % 7 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN k % 11 = 0 THEN '' ELSE prio END AS prio, st, pos FROM n WHERE k % 10 <> 0
  UNION ALL SELECT k + 10000000, price, prio, st, pos + 10000000 FROM n WHERE k % 25 = 0)"""
_BOTH = f"WITH {_NEW}, {_OLD} "


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("price"), F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("st"), F.col("o_orderkey").alias("pos"))


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _new(spark, sf_dir)
    kept = n.where("k % 10 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(F.col("k") % 11 == 0, "").otherwise(F.col("prio")).alias("prio"), "st", "pos")
    return kept.unionByName(n.where("k % 25 = 0").withColumns({"k": F.col("k") + 10000000, "pos": F.col("pos") + 10000000}))


_DIFF = """n.price IS DISTINCT FROM h.price OR n.prio IS DISTINCT FROM h.prio OR n.st IS DISTINCT FROM h.st"""
_STATUS = f"""d AS (SELECT coalesce(n.k, h.k) AS k, CASE WHEN h.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' ELSE 'modified' END AS status
  FROM n FULL JOIN h ON n.k = h.k WHERE n.k IS NULL OR h.k IS NULL OR {_DIFF})"""


@_query(f"{_BOTH}, {_STATUS} SELECT k, status FROM d")
def keyed_diff(spark, sf_dir):
    return diff.keyed_diff(_new(spark, sf_dir), _old(spark, sf_dir), "k").select("k", "status")


@_query(
    _BOTH
    + """SELECT n.k, 'price' AS field, CAST(h.price AS VARCHAR) AS old, CAST(n.price AS VARCHAR) AS new FROM n JOIN h ON n.k = h.k WHERE n.price IS DISTINCT FROM h.price
    UNION ALL SELECT n.k, 'prio', h.prio, n.prio FROM n JOIN h ON n.k = h.k WHERE n.prio IS DISTINCT FROM h.prio
    UNION ALL SELECT n.k, 'st', h.st, n.st FROM n JOIN h ON n.k = h.k WHERE n.st IS DISTINCT FROM h.st"""
)
def diff_changes_long(spark, sf_dir):
    return diff.changes_long(diff.keyed_diff(_new(spark, sf_dir), _old(spark, sf_dir), "k"), "k")


_SUMMARY = f"""{_BOTH}, {_STATUS}, s AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'modified') AS modified,
  (SELECT count(*) FROM n) AS total_new, (SELECT count(*) FROM h) AS total_historical FROM d)"""


@_query(f"{_SUMMARY} SELECT * FROM s")
def diff_summary(spark, sf_dir):
    new, old = _new(spark, sf_dir), _old(spark, sf_dir)
    return diff.diff_summary(diff.keyed_diff(new, old, "k"), new, old)


@_query(f"{_SUMMARY} SELECT '数据比较报告:' || chr(10) || '  新增: ' || added || ' 条' || chr(10) || '  删除: ' || deleted || ' 条' || chr(10) || '  修改: ' || modified || ' 条' || chr(10) || '  新数据总数: ' || total_new || ' 条' || chr(10) || '  历史数据总数: ' || total_historical || ' 条' AS report FROM s")
def diff_report(spark, sf_dir):
    return diff.summary_text(diff_summary(spark, sf_dir))


@_query(
    _BOTH
    + f""", {_STATUS} SELECT status AS section, CAST(d.k AS VARCHAR) || CASE WHEN status <> 'modified' THEN '' ELSE ': ' || concat_ws('; ',
    CASE WHEN n.price IS DISTINCT FROM h.price THEN 'price: ' || h.price || ' => ' || n.price END,
    CASE WHEN n.prio IS DISTINCT FROM h.prio THEN 'prio: ' || h.prio || ' => ' || n.prio END,
    CASE WHEN n.st IS DISTINCT FROM h.st THEN 'st: ' || h.st || ' => ' || n.st END) END AS line
    FROM d LEFT JOIN n ON d.k = n.k LEFT JOIN h ON d.k = h.k"""
)
def diff_detailed(spark, sf_dir):
    return diff.report_lines(diff.keyed_diff(_new(spark, sf_dir), _old(spark, sf_dir), "k"), "k")


@_query(f"{_BOTH} SELECT n.k FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = n.k)")
def diff_added(spark, sf_dir):
    return diff.keyed_diff(_new(spark, sf_dir), _old(spark, sf_dir), "k").where(F.col("status") == diff.ADDED).select("k")


@_query(f"{_BOTH} SELECT h.k FROM h WHERE NOT EXISTS (SELECT 1 FROM n WHERE h.k = n.k)")
def diff_deleted(spark, sf_dir):
    return diff.keyed_diff(_new(spark, sf_dir), _old(spark, sf_dir), "k").where(F.col("status") == diff.DELETED).select("k")


_SUPPLIERS = "s_suppkey AS k, s_name AS name, s_nationkey AS nation"
_SUPPLIED = f"""WITH n AS (SELECT {_SUPPLIERS} FROM supplier WHERE s_suppkey % 9 <> 0), h AS (SELECT k + CASE WHEN k % 5 = 0 THEN 1000000 ELSE 0 END AS k, name, nation + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS nation FROM (SELECT {_SUPPLIERS} FROM supplier)),
  a AS (SELECT k FROM n WHERE k NOT IN (SELECT k FROM h)), d AS (SELECT k FROM h WHERE k NOT IN (SELECT k FROM n)), m AS (SELECT n.k, 'nation: ' || h.nation || ' => ' || n.nation AS change FROM n JOIN h USING (k) WHERE n.nation <> h.nation)"""


@_query(
    f"""{_SUPPLIED} SELECT '数据比较报告:' || chr(10) || '  新增: ' || (SELECT count(*) FROM a) || ' 条' || chr(10) || '  删除: ' || (SELECT count(*) FROM d) || ' 条' || chr(10) || '  修改: ' || (SELECT count(*) FROM m) || ' 条' || chr(10)
    || '  新数据总数: ' || (SELECT count(*) FROM n) || ' 条' || chr(10) || '  历史数据总数: ' || (SELECT count(*) FROM h) || ' 条' || chr(10) || chr(10)
    || coalesce((SELECT '新增记录:' || chr(10) || string_agg('  + ' || k || chr(10), '' ORDER BY k) || chr(10) FROM a), '')
    || coalesce((SELECT '删除记录:' || chr(10) || string_agg('  - ' || k || chr(10), '' ORDER BY k) || chr(10) FROM d), '')
    || coalesce((SELECT '修改记录:' || chr(10) || string_agg('  * ' || k || ':' || chr(10) || '      ' || change || chr(10), '' ORDER BY k) FROM m), '') AS report"""
)
def detailed_report(spark, sf_dir):
    from .jobs import compare_report

    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("pos"))
    k = F.col("k")
    old = rows.withColumns({"k": k + F.when(k % 5 == 0, 1000000).otherwise(0), "nation": F.col("nation") + F.when(k % 4 == 0, 1).otherwise(0)})
    return compare_report(rows.where(k % 9 != 0), old, "k")


def _merge_query(name: str, policy, expression: str):
    def merged(spark, sf_dir):
        new = _new(spark, sf_dir).drop("pos")
        return merge.merge_with_history(new, _old(spark, sf_dir), "k", {"price": policy, "prio": policy})

    QUERIES[name] = merged
    cells = ", ".join(f"CASE WHEN h.k IS NULL THEN n.{c} ELSE {expression.format(c=c)} END AS {c}" for c in ("price", "prio"))
    ORACLES[name] = f"{_BOTH} SELECT n.k, {cells}, n.st FROM n LEFT JOIN h ON n.k = h.k"


_merge_query("merge_overwrite", OVERWRITE, "n.{c}")
_merge_query("merge_new_first", PREFER_NEW, "n.{c}")
_merge_query("merge_preserve", PRESERVE, "coalesce(h.{c}, n.{c})")
_merge_query("merge_priority", PREFER_OLD, "coalesce(h.{c}, n.{c})")


@_query(f"{_BOTH} SELECT n.k, n.price, CASE WHEN h.prio <> '' THEN h.prio ELSE n.prio END AS prio, n.st FROM n LEFT JOIN h ON n.k = h.k")
def merge_custom_nonempty(spark, sf_dir):
    return merge.merge_with_history(_new(spark, sf_dir).drop("pos"), _old(spark, sf_dir), "k", {"prio": KEEP_FILLED})


@_query(
    f"""{_BOTH}, n2 AS (SELECT * FROM n UNION ALL SELECT k, price + 5, CASE WHEN k % 2 = 0 THEN '' ELSE 'again' END, st, pos + 5000000 FROM n WHERE k % 13 = 0),
    h2 AS (SELECT * FROM h UNION ALL SELECT k, price - 1, prio, 'dup', pos + 20000000 FROM h WHERE k % 17 = 0), f AS (SELECT k, min(pos) AS first FROM h2 GROUP BY k),
    g AS (SELECT k, arg_max(price, pos) AS price, coalesce(arg_min(prio, pos) FILTER (WHERE prio <> ''), arg_max(prio, pos)) AS prio, arg_max(st, pos) AS st, min(pos) AS pos FROM n2 GROUP BY k)
    SELECT h2.k, CASE WHEN g.k IS NULL THEN h2.price ELSE g.price END AS price, CASE WHEN g.k IS NULL OR h2.prio <> '' THEN h2.prio ELSE g.prio END AS prio, CASE WHEN g.k IS NULL THEN h2.st ELSE g.st END AS st, h2.pos, false AS is_new
    FROM h2 LEFT JOIN f ON f.k = h2.k AND f.first = h2.pos LEFT JOIN g ON g.k = f.k
    UNION ALL SELECT k, price, prio, st, pos, true FROM g WHERE k NOT IN (SELECT k FROM h2)"""
)
def upsert_records(spark, sf_dir):
    """With keys that stand more than once on either side."""
    new, old, k = _new(spark, sf_dir), _old(spark, sf_dir), F.col("k")
    more = new.where(k % 13 == 0).withColumns({"price": F.col("price") + 5, "prio": F.when(k % 2 == 0, "").otherwise("again"), "pos": F.col("pos") + 5000000})
    twice = old.where(k % 17 == 0).withColumns({"price": F.col("price") - 1, "st": F.lit("dup"), "pos": F.col("pos") + 20000000})
    return merge.upsert(new.unionByName(more), old.unionByName(twice), "k", {"prio": KEEP_FILLED})


_ORDER = TableBuilder().field("k", "number").field("price", "number").field("prio", "string").field("st", "string").direct("prio", "o_orderpriority").direct("st", "o_orderstatus").direct("k", "o_orderkey").computed("price", lambda df: F.round("o_totalprice")).build()


@_query(f"WITH {_NEW} SELECT CAST(k AS DOUBLE) AS k, CAST(price AS DOUBLE) AS price, prio, st FROM n")
def replace_records(spark, sf_dir):
    """A full replacement takes the mapped rows and nothing of history."""
    return _ORDER.map(_read(spark, sf_dir, "orders"))


_CUSTOMER = (
    TableBuilder()
    .field("id", "integer").title(en="Id").required()
    .field("name", "string").field("segment", "string").default("none").field("label", "string").field("kind", "string").field("rank", "integer").default(7).field("flag", "boolean").field("gap", "string").default("-")
    .direct("id", "c_custkey")
    .transformed("name", "c_name", lambda df: F.lower(F.col("c_name")))
    .direct("segment", "no_such_column")
    .computed("label", lambda df: F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")))
    .constant("kind", "customer").filled("flag", True).ignored("rank")
    .key("id").build()
)


@_query("SELECT CAST(c_custkey AS INTEGER) AS id, lower(c_name) AS name, 'none' AS segment, c_mktsegment || '/' || c_nationkey AS label, 'customer' AS kind, 7 AS rank, true AS flag, '-' AS gap FROM customer")
def map_all_kinds(spark, sf_dir):
    return _CUSTOMER.map(_read(spark, sf_dir, "customer"))


_SLOT_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@_query(
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SLOT_ORDER}) AS i FROM lineitem) SELECT l_orderkey, "
    + ", ".join(f"max(CASE WHEN i = {i} THEN l_partkey END) AS item{i}, max(CASE WHEN i = {i} THEN CAST(round(l_quantity) AS BIGINT) END) AS amount{i}" for i in range(1, 7))
    + " FROM r GROUP BY l_orderkey"
)
def slots_wide(spark, sf_dir):
    """Positional slots 1 to 6 of each order's items; further items have no slot."""
    item = F.struct(*(F.col(c.strip()) for c in _SLOT_ORDER.split(",")))
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return items.select("l_orderkey", *(c for i in range(6) for c in (F.get("items", F.lit(i))["l_partkey"].alias(f"item{i + 1}"), F.round(F.get("items", F.lit(i))["l_quantity"]).cast("long").alias(f"amount{i + 1}"))))


@_query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_name) AS product, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 1) AS numtogive, CASE WHEN p_size < 10 THEN coalesce(CASE WHEN p_size < 5 THEN true END, false) END AS no_deconstruction FROM part")
def option_defaults(spark, sf_dir):
    size = F.col("p_size")
    return _read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(size > 25, F.col("p_brand")), "p_name").alias("product"), F.coalesce(F.when(size % 2 == 0, size), F.lit(1)).alias("numtogive"), F.when(size < 10, F.coalesce(F.when(size < 5, True), F.lit(False))).alias("no_deconstruction"))


_PART_KEYS = "CASE WHEN p_size % 3 = 0 THEN p_name || (p_size % 2) END AS description, CASE WHEN p_size % 3 = 1 THEN p_name END AS product, p_name AS name"


@_query(
    f"""WITH dim AS (SELECT 'D.' || upper(p_name) AS k, arg_max(p_type, p_partkey) AS v FROM part WHERE p_size % 2 = 0 GROUP BY 1),
    p AS (SELECT p_partkey, {_PART_KEYS} FROM part)
    SELECT p_partkey, CASE WHEN description IS NOT NULL THEN d.v ELSE coalesce(e.v, f.v) END AS "desc" FROM p
    LEFT JOIN dim d ON d.k = 'D.' || upper(description) LEFT JOIN dim e ON e.k = 'D.' || upper(product) LEFT JOIN dim f ON f.k = 'D.' || upper(name)"""
)
def lookup_fallback(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    dim = part.where("p_size % 2 = 0").select(F.concat(F.lit("D."), F.upper("p_name")).alias("k"), F.col("p_type").alias("v"), F.col("p_partkey").alias("pos"))
    keyed = part.selectExpr("p_partkey", *_split_items(_PART_KEYS))
    return lookup.with_fallbacks(keyed, lookup.last_wins(dim, "k", "v", "pos"), "k", "v", "description", ["product", "name"], "D.", "desc").select("p_partkey", "desc")


def _split_items(items: str) -> list[str]:
    return [x.strip() for x in items.split(", ")]


@_query("SELECT p_name, arg_max(p_type, p_partkey) AS p_type FROM part GROUP BY p_name")
def lookup_last_wins(spark, sf_dir):
    return lookup.last_wins(_read(spark, sf_dir, "part"), "p_name", "p_type", "p_partkey")


@_query("SELECT p_name, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY p_name")
def lookup_first_wins(spark, sf_dir):
    return lookup.first_wins(_read(spark, sf_dir, "part"), "p_name", "p_type", "p_partkey")


@_query("WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT pos FROM r WHERE p_size = 9 ORDER BY pos LIMIT 1")
def point_lookup_idx(spark, sf_dir):
    return lookup.find_place(_read(spark, sf_dir, "part"), "p_size", 9, "p_partkey")


@_query("SELECT * FROM part WHERE p_size = 9 ORDER BY p_partkey LIMIT 1")
def point_lookup(spark, sf_dir):
    return lookup.find_record(_read(spark, sf_dir, "part"), "p_size", 9, "p_partkey")


@_query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS level FROM orders")
def const_dim_resolve(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", lookup.resolve_constant(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}).alias("level"))


_URL_KINDS = {"https://m.": "mobile", "https://": "secure", "http://": "plain"}
_URL_CASE = "CASE WHEN starts_with(url, 'https://m.') THEN 'mobile' WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain' END"


@_query(f"SELECT page_id, {_URL_CASE} AS category FROM pages")
def prefix_category(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.category(F.col("url"), _URL_KINDS).alias("category"))


@_query(f"SELECT page_id FROM pages WHERE {_URL_CASE} = 'secure'")
def filter_category(spark, sf_dir):
    return _read(spark, sf_dir, "pages").where(X.category(F.col("url"), _URL_KINDS) == "secure").select("page_id")


@_query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN lower(substr(url, 9)) END AS id FROM pages")
def strip_prefix_lower(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.lower(X.strip_prefix(F.col("url"), "https://")).alias("id"))


_BUCKET = "CASE WHEN starts_with(p_type, 'S') THEN 'stations' WHEN starts_with(p_type, 'L') THEN 'craftings' END"


@_query(f"SELECT {_BUCKET} AS bucket, p_name, arg_max(p_brand, p_partkey) AS brand, arg_max(p_size, p_partkey) AS size FROM part WHERE {_BUCKET} IS NOT NULL GROUP BY 1, 2")
def two_bucket_nested(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(X.category(F.col("p_type"), {"S": "stations", "L": "craftings"}).alias("bucket"), "p_name", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_partkey")
    return lookup.nested_names(part, "bucket", "p_name", ["brand", "size"], "p_partkey").select("bucket", F.explode("names").alias("p_name", "v")).select("bucket", "p_name", "v.*")


@_query("SELECT DISTINCT p_name AS name FROM part WHERE p_size > 45 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 3) ORDER BY name")
def distinct_except_sorted(spark, sf_dir):
    name = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size")
    return sets.missing_names(name.where("p_size > 45"), name.where("p_size <= 3"))


@_query("WITH f AS (SELECT DISTINCT p_name FROM part WHERE p_size > 45), l AS (SELECT DISTINCT p_name FROM part WHERE p_size <= 3), e AS (SELECT count(*) AS n FROM f WHERE p_name NOT IN (SELECT p_name FROM l)) SELECT (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM l) AS n_listed, n AS n_extra, n > 0 AS has_extra FROM e")
def set_report_counts(spark, sf_dir):
    name = _read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size")
    return sets.set_report(name.where("p_size > 45"), name.where("p_size <= 3"))


_LINES = "unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)))"


@_query(f"SELECT doc_id, {_LINES} AS line FROM documents WHERE text <> ''")
def line_split(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(X.lines(F.col("text"))).alias("line"))


@_query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_LINES} AS line FROM documents WHERE text <> '') WHERE starts_with(trim(line), 'The ') GROUP BY doc_id")
def line_predicate(spark, sf_dir):
    return line_split(spark, sf_dir).where(X.trim_space(F.col("line")).startswith("The ")).groupBy("doc_id").agg(F.count("*").alias("n"))


_PAIRS = "p AS (SELECT a.doc_id AS k, a.text AS old, b.text AS new FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)"
_LINE_DIFF = f"""WITH {_PAIRS}, o AS (SELECT k, unnest(string_split(regexp_replace(old, '\\n\\z', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(old, '\\n\\z', ''), chr(10)), 1) - 1 AS line FROM p WHERE old <> ''),
  n AS (SELECT k, unnest(string_split(regexp_replace(new, '\\n\\z', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(new, '\\n\\z', ''), chr(10)), 1) - 1 AS line FROM p WHERE new <> ''),
  d AS (SELECT coalesce(o.k, n.k) AS k, coalesce(o.line, n.line) AS line, CASE WHEN n.t IS NULL THEN 'removed' WHEN trim(o.t) = trim(n.t) THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.k = n.k AND o.line = n.line)"""


def _text_pairs(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), F.col("text").alias("old"))
    return old.join(d.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("k"), F.col("text").alias("new")), "k")


@_query(f"{_LINE_DIFF} SELECT k, line, status FROM d")
def line_diff(spark, sf_dir):
    return diff.line_diff(_text_pairs(spark, sf_dir), "k", "old", "new")


@_query(f"{_LINE_DIFF} SELECT count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed FROM d")
def line_diff_counts(spark, sf_dir):
    return diff.line_diff_counts(line_diff(spark, sf_dir))


@_query("SELECT page_id, substr(html, 1, instr(html, '<title>') + 6) || chr(10) || 'page ' || page_id || chr(10) || substr(html, instr(html, '</title>')) AS html FROM pages")
def marker_replace(spark, sf_dir):
    new = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return _read(spark, sf_dir, "pages").select("page_id", X.replace_between_markers(F.col("html"), new, "<title>", "</title>").alias("html"))


@_query("SELECT page_id, substr(html, instr(html, '<title>') + 7, instr(html, '</title>') - instr(html, '<title>') - 7) AS title FROM pages")
def marker_extract(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.between_markers(F.col("html"), "<title>", "</title>").alias("title"))


_LAST = "length(html) - instr(reverse(html), '>p/<') - 2"


@_query(f"SELECT page_id, CASE WHEN instr(html, '<p>') > 0 AND instr(reverse(html), '>p/<') > 0 AND instr(html, '<p>') < {_LAST} THEN substr(html, 1, instr(html, '<p>') + 2) || 'x' || chr(10) || substr(html, {_LAST}) END AS html FROM pages")
def span_first_last(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.splice_brackets(F.col("html"), F.lit("x"), "<p>", "</p>").alias("html"))


_OUTSIDE = "[^\\p{L}\\p{N}_]"


@_query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '(^|{_OUTSIDE})the($|{_OUTSIDE})', '\\1_X_\\2', 'g'), '(^|{_OUTSIDE})the($|{_OUTSIDE})', '\\1_X_\\2', 'g') AS text FROM documents")
def ident_replace(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.replace_identifier(F.col("text"), "the", "_X_").alias("text"))


@_query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name || coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, '') END AS joined FROM part")
def lua_concat_nulls(spark, sf_dir):
    left, right = F.when(F.col("p_size") % 3 != 0, F.col("p_name")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return _read(spark, sf_dir, "part").select("p_partkey", X.lua_concat(left, right).alias("joined"))


@_query("SELECT c_custkey, i, c_name || '_' || i AS name FROM customer, (SELECT unnest([1, 2, 3]) AS i)")
def loop_expand(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    return rows.select("c_custkey", "i", F.concat("c_name", F.lit("_"), F.col("i").cast("string")).alias("name"))


@_query("SELECT c_custkey, CASE c_nationkey WHEN 1 THEN '8' WHEN 2 THEN '6' WHEN 3 THEN '4' END AS amount FROM customer")
def index_csv_table(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", X.at_index(F.lit("8, 6, 4"), F.col("c_nationkey")).alias("amount"))


@_query("SELECT event_id, CASE WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN TRY_CAST(trim(t) AS INTEGER) END AS n FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' || json_extract_string(props, '$.k') END AS t FROM events)")
def parse_numbers(spark, sf_dir):
    token = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.get_json_object("props", "$.k")))
    return _read(spark, sf_dir, "events").select("event_id", X.parse_int(token).alias("n"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_get(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@_query("SELECT n_nationkey, CAST(json_array(n_name, n_nationkey, NULL, n_regionkey > 1) AS VARCHAR) AS record FROM nation")
def json_record(spark, sf_dir):
    from ..sources.tabular import record_json

    nation = _read(spark, sf_dir, "nation").withColumns({"gap": F.lit(None).cast("string"), "far": F.col("n_regionkey") > 1})
    return nation.select("n_nationkey", record_json("n_name", "n_nationkey", "gap", "far").alias("record"))


@_query(f"{_BOTH} SELECT n.k, 'prio: ' || coalesce(h.prio, 'null') || ' => ' || coalesce(n.prio, 'null') AS line FROM n JOIN h ON n.k = h.k WHERE n.prio IS DISTINCT FROM h.prio")
def format_change(spark, sf_dir):
    changes = diff.changes_long(diff.keyed_diff(_new(spark, sf_dir), _old(spark, sf_dir), "k"), "k")
    return changes.where("field = 'prio'").select("k", X.show_change(F.col("field"), F.col("old"), F.col("new")).alias("line"))


@_query("SELECT event_id, TRY_CAST(t AS FLOAT) AS f FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_id || '.25' ELSE ' 1' END AS t FROM events) WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2")
def parse_floats(spark, sf_dir):
    k = F.col("event_id")
    token = F.when(k % 3 == 0, F.col("event_type")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".25"))).otherwise(" 1")
    return _read(spark, sf_dir, "events").select("event_id", X.parse_float(token).alias("f"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM events")
def parse_bools(spark, sf_dir):
    token = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("True"), F.col("event_type")), (F.col("event_id") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", X.parse_bool(token).alias("b"))


@_query("SELECT event_id, event_id % 2 = 0 AS due FROM events")
def json_changed(spark, sf_dir):
    """The same value with other spacing, and for even ids another value."""
    new = F.concat(F.lit(" "), F.replace("props", F.lit(":"), F.lit(" : ")), F.lit("\n"))
    other = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), new, F.lit("]"))).otherwise(new)
    return _read(spark, sf_dir, "events").select("event_id", diff.content_changed(F.col("props"), other, json=True).alias("due"))


@_query("SELECT upper(p_name) || '_' || p_partkey AS code, p_type AS name FROM part WHERE p_size % 2 = 0")
def entity_names(spark, sf_dir):
    from ..sources import po

    context = F.concat(F.when(F.col("p_size") % 2 == 0, "STRINGS.NAMES.").otherwise("STRINGS.UI."), F.upper("p_name"), F.lit("_"), F.col("p_partkey").cast("string"))
    return po.entity_names(_read(spark, sf_dir, "part").select(context.alias("msgctxt"), F.col("p_type").alias("msgstr")))


_TECHS = "SELECT DISTINCT 'TECH.' || p_brand AS name FROM part WHERE p_size > 45"


@_query(f"SELECT name FROM ({_TECHS})")
def listed_names(spark, sf_dir):
    """Quoted names that open lines of a text; a line with another start lists none."""
    lines = F.concat(F.when(F.col("p_size") > 45, "  ").otherwise("x "), F.lit("'TECH."), "p_brand", F.lit("', 1\n-- 'TECH.NO'"))
    return sets.listed_names(_read(spark, sf_dir, "part").select(lines.alias("text")), "text")


@_query(
    """WITH f AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 45), l AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size <= 2), e AS (SELECT name FROM f WHERE name NOT IN (SELECT name FROM l))
    SELECT '=== Tech 比较报告 ===' || chr(10) || chr(10) || '解析出的Tech数量: ' || (SELECT count(*) FROM f) || chr(10) || 'Wiki页面中的Tech数量: ' || (SELECT count(*) FROM l) || chr(10) || '解析中有但Wiki中没有的Tech数量: ' || (SELECT count(*) FROM e) || chr(10) || chr(10)
    || coalesce((SELECT '解析中有但Wiki中没有的Tech:' || chr(10) || string_agg('  - ' || name || chr(10), '' ORDER BY name) FROM e), '所有解析出的Tech都存在于Wiki页面中。' || chr(10)) AS report"""
)
def tech_report(spark, sf_dir):
    name = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), "p_size")
    return sets.report_text(name.where("p_size > 45"), name.where("p_size <= 2"))


@_query("SELECT n_nationkey, 'Language: ' || n_name || chr(10) || 'Plural: ' || n_regionkey AS header FROM nation")
def po_headers(spark, sf_dir):
    from ..sources import po

    text = F.concat(F.lit('msgid ""\nmsgstr ""\n"Language: '), "n_name", F.lit('\\n"\n"Plural: '), F.col("n_regionkey").cast("string"), F.lit('\\n"\n\nmsgid "a"\nmsgstr "b"\n'))
    return po.read_headers(_read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "text", "n_nationkey")


@_query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_extend(spark, sf_dir):
    return _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(_read(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def preview_limit(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(10)


#: Rows that one rendered file holds in the round trips.
_FILE_ROWS = 50


def _file(key: Column) -> Column:
    return F.floor(key / _FILE_ROWS).alias("file")


def _files(rows: DataFrame, key: str, text: str, separator: str) -> DataFrame:
    """`text` of each `file` of _FILE_ROWS neighbouring keys, every row rendered in key order."""
    listed = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(key, text))).alias("rows"))
    return listed.select("file", F.array_join(F.transform("rows", lambda r: r[text]), separator).alias("text"))


@_query("""SELECT lower(p_name || '_' || p_partkey) AS id, p_type || chr(9) || '\\' || p_brand AS name_cn, p_name || ' "' || p_size || '"' AS name_en, p_name || ' "' || p_size || '".png' AS item_img1 FROM part""")
def po_roundtrip(spark, sf_dir):
    from ..sources import po
    from .tables import NAMES, item_rows

    part = _read(spark, sf_dir, "part")
    msgstr = F.concat("p_type", F.lit("\t\\"), "p_brand")
    entry = po.entry_text(F.concat(F.lit(NAMES), F.upper("p_name"), F.lit("_"), F.col("p_partkey").cast("string")), F.concat("p_name", F.lit(' "'), F.col("p_size").cast("string"), F.lit('"')), msgstr)
    files = _files(part.select(_file(F.col("p_partkey")), "p_partkey", entry.alias("t")), "p_partkey", "t", "\n\n")
    return item_rows(po.read_entries(files, "text")).drop("pos")


@_query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SLOT_ORDER}) AS i FROM lineitem), w AS (SELECT l_orderkey, """
    + ", ".join(f"max(CASE WHEN i = {i} THEN 'p' || l_partkey END) AS ingredient{i}, max(CASE WHEN i = {i} THEN CAST(round(l_quantity) AS INTEGER) END) AS amount{i}" for i in range(1, 7))
    + """ FROM r GROUP BY l_orderkey) SELECT 'order_' || l_orderkey AS recipe_name, w.* EXCLUDE (l_orderkey), CASE WHEN l_orderkey % 2 = 0 THEN 'thing' ELSE 'order_' || l_orderkey END AS product,
    CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END AS numtogive, 'TECH.' || CASE WHEN l_orderkey % 5 = 0 THEN 'NONE' ELSE 'MAGIC_TWO' END AS tech, CASE WHEN l_orderkey % 7 = 0 THEN true END AS nounlock FROM w"""
)
def recipe_roundtrip(spark, sf_dir):
    from ..sources import lua
    from .tables import RECIPE_TABLE, recipe_rows

    k = F.col("l_orderkey")
    slot = F.struct(*(F.col(c.strip()) for c in _SLOT_ORDER.split(",")))
    slots = _read(spark, sf_dir, "lineitem").select(_file(k), "l_orderkey", slot.alias("slot")).repartition("file")  # the one shuffle: by order it would take two
    items = slots.groupBy("file", "l_orderkey").agg(F.sort_array(F.collect_list("slot")).alias("items"))
    calls = F.array_join(F.transform("items", lambda i: F.concat(F.lit('Ingredient("p'), i["l_partkey"].cast("string"), F.lit('", '), F.round(i["l_quantity"]).cast("int").cast("string"), F.lit(")"))), ", ")
    options = F.concat_ws(", ", F.when(k % 2 == 0, F.lit('product = "thing"')), F.when(k % 3 == 0, F.lit("numtogive=2")), F.when(k % 7 == 0, F.lit("nounlock = true")))
    name = F.concat(F.lit('Recipe2("order_'), k.cast("string"), F.lit('", {'))
    tech = F.concat(F.lit("}, TECH."), F.when(k % 5 == 0, "NONE").otherwise("MAGIC_TWO"), F.lit(", {"))
    call = F.concat(name, calls, tech, options, F.lit("})"))
    files = _files(items.select("file", "l_orderkey", call.alias("t")), "l_orderkey", "t", "\n-- next\n")
    wanted = [n for n in RECIPE_TABLE.names() if n.startswith(("ingredient", "amount"))]
    return recipe_rows(lua.read_recipes(files, "text")).select("recipe_name", *wanted, "product", "numtogive", "tech", "nounlock")


@_query("SELECT n_nationkey, CAST(23 + length(CAST(n_nationkey AS VARCHAR)) AS BIGINT) AS start_byte, 'T.wanted = { name = \"' || n_name || '\", 1 }' AS content, false AS is_local FROM nation")
def lua_span_roundtrip(spark, sf_dir):
    from ..sources import lua

    nation = _read(spark, sf_dir, "nation")
    source = F.concat(F.lit("-- T.wanted\nlocal a = "), F.col("n_nationkey").cast("string"), F.lit("\n"), F.lit('T.wanted = { name = "'), "n_name", F.lit('", 1 }\nT.other = function() T.wanted = 2 end\n'))
    return lua.read_spans(nation.select("n_nationkey", source.alias("text")), "text", "T.wanted", None, "n_nationkey").select("n_nationkey", "start_byte", "content", "is_local")
