import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import diff, lookup, merge
from quillmark.operators.mapping import KEEP_FILLED, OVERWRITE, PRESERVE, TableBuilder, custom


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first().x


def test_builder_acts_on_the_last_field_and_keeps_order(spark):
    t = TableBuilder().field("a", "string").title(en="A").required().field("b", "integer").default(3).direct("a", "x").policy("a", PRESERVE).policy("none", PRESERVE).build()
    assert t.names() == ["a", "b"] and t.key == "a" and t.fields[0].required and t.fields[1].default == 3
    assert t.policies() == {"a": PRESERVE} and t.fields[1].described()["type"] == "number"
    assert [f.dataType.simpleString() for f in t.schema()] == ["string", "int"]
    assert TableBuilder().build().key == ""
    with pytest.raises(ValueError):
        TableBuilder().field("a", "date")


@pytest.mark.parametrize("policy, old, want", [(OVERWRITE, "old", "new"), (PRESERVE, "old", "old"), (PRESERVE, None, "new"), (KEEP_FILLED, "", "new"), (KEEP_FILLED, "old", "old"), (custom(lambda n, o: F.concat(n, F.lit("+"), o)), "old", "new+old")])
def test_policies(spark, policy, old, want):
    new = spark.createDataFrame([("k", "new"), (None, "new")], "id string, v string")
    history = spark.createDataFrame([("k", old, 1), ("k", "later", 2), ("h", "x", 3)], "id string, v string, pos long")
    got = {r.id: r.v for r in merge.merge_with_history(new, history, "id", {"v": policy}).collect()}
    assert got == {"k": want, None: "new"}


def test_upsert_keeps_history_order_and_appends(spark):
    new = spark.createDataFrame([("b", "B", 0), ("z", "Z", 1), ("z", "ZZ", 2)], "id string, v string, pos long")
    history = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "id string, v string, pos long")
    assert [(r.id, r.v) for r in merge.upsert(new, history, "id", {}).orderBy("is_new", "pos").collect()] == [("a", "1"), ("b", "B"), ("z", "ZZ")]


@pytest.mark.parametrize("policy", [OVERWRITE, PRESERVE, KEEP_FILLED, custom(lambda n, o: F.concat(o, F.lit("+"), n))])
def test_upsert_of_repeated_keys(spark, policy):
    news = [("a", "A"), ("z", "Z"), ("z", None), ("z", "ZZ"), (None, "N"), ("b", ""), ("z", "Y"), (None, "M"), ("q", ""), ("q", "Q")]
    olds = [("a", "1"), ("a", "dup"), ("b", ""), ("c", None), (None, None), ("b", "3")]
    new = spark.createDataFrame([(*r, i) for i, r in enumerate(news)], "id string, v string, pos long")
    history = spark.createDataFrame([(*r, (1 << 41) + i) for i, r in enumerate(olds)], "id string, v string, pos long")
    both = spark.createDataFrame([("", "")], "n string, o string")

    def merged(n, o):
        row = spark.createDataFrame([(n, o)], both.schema)
        return row.select(policy.combine(F.col("n"), F.col("o")).alias("x")).first().x

    want = [list(r) for r in olds]
    for key, value in news:
        match = next((r for r in want if r[0] == key), None)
        if match is None:
            want.append([key, value])
        else:
            match[1] = merged(value, match[1])
    got = merge.upsert(new, history, "id", {"v": policy}).orderBy("is_new", "pos").collect()
    assert [[r.id, r.v] for r in got] == want


def test_diff_matches_null_keys_and_keeps_duplicates(spark):
    new = spark.createDataFrame([(None, "a", 0), ("x", "n", 1), ("x", "n", 2), ("y", None, 3)], "id string, v string, pos long")
    old = spark.createDataFrame([(None, "b", 0), ("y", None, 1), ("d", "q", 2), ("d", "q", 3)], "id string, v string, pos long")
    got = diff.keyed_diff(new, old, "id")
    assert sorted((str(r.id), r.status) for r in got.collect()) == [("None", "modified"), ("d", "deleted"), ("d", "deleted"), ("x", "added"), ("x", "added")]
    assert [tuple(r) for r in diff.changes_long(got, "id").collect()] == [(None, "v", "b", "a")]


@pytest.mark.parametrize("old, new, want", [("a\nb\nc", "a\nb\nc", (3, 0, 0)), ("a\nb\nc", "a\nB\nc", (2, 1, 0)), ("a\nb", "a", (1, 0, 1)), ("a", "a\nb", (1, 1, 0)), ("", "", (0, 0, 0)), (" a\t\nb", "a\n b\r\n", (2, 0, 0))])
def test_line_diff(spark, old, new, want):
    pair = spark.createDataFrame([(1, old, new)], "k int, o string, n string")
    assert tuple(diff.line_diff_counts(diff.line_diff(pair, "k", "o", "n")).first()) == want


def test_line_diff_keeps_pairs_that_share_a_key_apart(spark):
    pairs = spark.createDataFrame([(1, "a\nb", "a\nc"), (1, "x", "x"), (1, None, "y"), (1, "z", None)], "k int, o string, n string")
    assert sorted((r.line, r.status) for r in diff.line_diff(pairs, "k", "o", "n").collect()) == [(0, "changed"), (0, "removed"), (0, "unchanged"), (0, "unchanged"), (1, "changed")]


def test_json_is_compared_by_value(spark):
    changed = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(diff.content_changed(F.col("a"), F.col("b"), json=True).alias("x")).first().x
    assert not changed('{"a":1,"b":[1]}', ' {\n "b": [1],\n "a": 1}\n') and changed('{"a":1}', '{"a":2}') and changed("x", "y") and not changed(" x", "x")


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, X.replace_identifier(t, "i", "$1\\"), t="i ii i_ (i) 中i i中") == "$1\\ ii i_ ($1\\) 中i i中"
    assert one(spark, X.lines(t), t="a\r\nb\n\n") == ["a", "b", ""] and one(spark, X.lines(t), t="") == []
    assert one(spark, X.trim_space(t), t="　\ta b ") == "a b"
    assert one(spark, X.replace_between_markers(t, F.lit("n")), t=f"{X.END_MARK}{X.START_MARK}") is None
    assert one(spark, X.splice_brackets(t, F.lit("n")), t="a[[b[[c]]d]]e") == "a[[n\n]]e"
    assert one(spark, X.quoted_token(t, "TECH."), t="  'TECH.A', 'TECH.B'") == "TECH.A" and one(spark, X.quoted_token(t, "TECH."), t="x 'TECH.A'") is None
    assert [one(spark, X.parse_int(t), t=v) for v in (" 12 ", "-3", "1.5", "99999999999", "")] == [12, -3, None, None, None]
    assert [one(spark, X.parse_bool(t), t=v) for v in ("true", "false", "True")] == [True, False, None]
    assert [one(spark, X.at_index(t, F.lit(i)), t="8, 6 ,4") for i in (0, 1, 3, 4)] == [None, "8", "4", None]
    assert one(spark, X.show_change(F.lit("name"), t, F.lit(None)), t="old") == "name: old => null"
    assert one(spark, X.last_position(t, "ab"), t="abxab") == 3 and one(spark, X.position(t, "q"), t="abxab") is None


def test_point_lookups(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2), (None, 3)], "v string, pos long")
    assert [lookup.find_index(df, "v", x, "pos").collect() for x in ("b", "c")] == [[(1,)], []]
    assert lookup.find_record(df, "nope", 1, "pos").count() == 0
    assert [lookup.find_place(df, "v", x, "pos").collect() for x in ("b", "c", None)] == [[(1,)], [], [(3,)]]
    assert lookup.find_place(df.limit(0), "v", "b", "pos").count() == 0
