"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Word unigrams and bigrams are hashed into BUCKETS. Their shares among trusted documents and
among all documents make two multinomials; a document's score is the mean log ratio of its
n-grams, and it is kept if it does not fail the base rules and scores THRESHOLD or more.

The counts of the raw corpus cover every document. Trusted are the documents whose label is
of good quality, at most TRUSTED of them, chosen by the hash of their ids.

Null, empty and blank texts have no words, so they fail the base rules; their score is 0.
Without trusted documents every score is 0. Rows are judged one by one, so repeated rows and
ids stay; other columns of the input are not read. No documents give no rows. The words and
windows of a text are JVM arrays, about 40 bytes a word while it is judged; places of words
have 28 bits, so a text of over 268 million words, 0.5 GB at least, is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

BUCKETS, TRUSTED, SMOOTHING, THRESHOLD = 1 << 14, 16384, 1.0, -0.065
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: White space apart from the space itself, and the symbols that are counted.
_SPACES, _SYMBOLS = "\t\n\x0b\x0c\r", "#*$%&|<>"
#: Low bits of a sorted key that hold a place; the others hold a part of a hash.
_PLACE_BITS = 28


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    for c in _SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _symbols(text: Column) -> Column:
    bare = text
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c))
    return F.octet_length(text) - F.octet_length(bare)


def _recurring(hashes: Column, places: Column, low: int) -> Column:
    """The places, of those given, whose hash shares 36 of its bits with that of another one.

    One sort of longs brings them together; `low` says from which bit the 36 are taken."""
    mask = (1 << 36) - 1

    def key(place: Column) -> Column:
        bits = F.shiftrightunsigned(F.get(hashes, place.cast("int")), low).bitwiseAND(F.lit(mask))
        return F.shiftleft(bits, _PLACE_BITS).bitwiseOR(place)

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftrightunsigned(a.bitwiseXOR(b), _PLACE_BITS) == 0, F.lit(False))

    keys = F.when(F.size(hashes) > 1 << _PLACE_BITS, F.raise_error(F.lit("a text has too many words")).cast("array<bigint>")).otherwise(F.sort_array(F.transform(places, key)))
    # The sorted keys are bound once, as the only element of an array, so that they are not sorted for each place.
    found = F.transform(F.array(keys), lambda s: F.filter(s, lambda k, i: equal(k, F.get(s, i + 1)) | equal(k, F.get(s, i - 1))))
    return F.transform(found[0], lambda k: k.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))


def _repeat_words(windows: Column) -> Column:
    """Words inside 3-word windows that stand in the text twice or more. Windows are compared by
    72 bits of their hash, in two rounds, the second among what the first has found."""
    rough = _recurring(windows, F.sequence(F.lit(0).cast("long"), F.size(windows).cast("long") - 1), 0)
    exact = F.transform(F.array(rough), lambda r: F.when(F.size(r) > 0, _recurring(windows, r, 28)).otherwise(r))[0]
    covered = F.flatten(F.transform(exact, lambda p: F.array(p, p + 1, p + 2)))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(F.size(F.array_distinct(covered)))


def with_words(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.col("doc_id").cast("long"), text.alias("text"), split_words(text).alias("words"))


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, words and the base counts of every row, and the columns to keep."""
    words, n = F.col("words"), F.size("words")
    windows = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(" " + _SPACES)) != "")
    counted = with_words(docs, keep).select(*keep, "doc_id", "text", "words", windows.alias("windows"), lines.alias("lines"))
    return counted.select(
        *keep,
        "doc_id",
        "words",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _symbols(F.col("text")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("windows") < 2, 0).otherwise(_repeat_words(F.col("windows"))).cast("long").alias("n_repeat_words"),
    )


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(share among trusted / share among all) for each bucket."""
    trusted = hash_sample(labels.where("quality = 1").select(F.col("doc_id").cast("long")), "doc_id", TRUSTED)
    marked = with_words(docs).join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    pairs = F.arrays_zip(F.col("words").alias("w"), F.slice("words", 2, F.size("words")).alias("x"))
    pairs = marked.select("trusted", F.explode(pairs).alias("p"))
    grams = pairs.select("trusted", F.explode(F.array(_bucket(F.col("p.w")), F.when(F.col("p.x").isNotNull(), _bucket(F.col("p.w"), F.col("p.x"))))).alias("bucket"))
    rows = grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted")).collect()  # BUCKETS rows at most
    raw, good = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for r in rows:
        raw[r.bucket] += r.raw
        good[r.bucket] += r.trusted
    if not any(r.trusted for r in rows):
        return [0.0] * BUCKETS
    all_raw, all_good = math.fsum(raw), math.fsum(good)
    return [round(math.log(g / all_good) - math.log(r / all_raw), 4) for g, r in zip(good, raw)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every row of docs, and the columns to keep."""
    model = F.split(F.lit(",".join(map(str, log_ratios(docs, labels)))), ",").cast("array<double>")
    words = F.col("words")

    def gain(total: Column, item: Column) -> Column:
        one = F.get(model, _bucket(item["w"]))
        two = F.when(item["x"].isNotNull(), F.get(model, _bucket(item["w"], item["x"]))).otherwise(0.0)
        return total + one + two

    pairs = F.arrays_zip(words.alias("w"), F.slice("words", 2, F.size("words")).alias("x"))
    total = F.aggregate(pairs, F.lit(0.0), gain)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    counts = base_counts(docs, keep)
    scored = counts.select(
        *(c for c in counts.columns if c != "words"),
        failed.alias("base_failed"),
        F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0).alias("score"),
    )
    judged = scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # Behind a generator, as a filter on the results, pushed down into the expressions, would split the text for every word.
    return judged.select(F.inline(F.array(F.struct(*judged.columns))))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept."""
    packed = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc"), "doc_id", "text")
    return judge(packed, labels, keep=("doc",)).where("kept").select("doc.*")
