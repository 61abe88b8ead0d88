"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of such texts lie about 10 of 64 bits apart, where a vantage-point tree prunes
nothing (see simhash). So candidates come from min-wise hashes of the shingle sets: BANDS keys
of ROWS minima each. A pair of similarity 0.8 shares a key with probability 1 - (1 - 0.8^5)^24,
0.9999. Documents with a key in common are a group; each is paired with the group's first and
last row, never with all, so a group of any size gives two pairs a row, and what several
groups link, connects. Pairs are confirmed by the exact similarity of the whole texts: each
row's most shared pair first, then every pair that these do not connect yet.

What may be lost: a link between two rows that are, in each of their common groups, unlike
both the first and the last row of it. The tests measure against brute force.

Words are those of simhash. A text of fewer words is one shingle; a text without words has no
shingles and resembles nothing. Repeated shingles count once. A very long text takes memory
for its words and shingles once. No rows give no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import connected_components

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 5
_SHINGLES_AT_ONCE = 2048
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _draw.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of one UTF-8 text as sorted 64-bit hashes."""
    tokens = text.lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    n = len(tokens) - size + 1 if tokens else 0
    grams = np.full(n, size, np.uint64)
    for k in range(size):
        grams = _mixed(grams * _STEP + hashes[k : k + n])
    return np.unique(grams)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """A key for each band of minima of a shingle set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), _SHINGLES_AT_ONCE):
        np.minimum(least, (grams[lo : lo + _SHINGLES_AT_ONCE] * _FACTORS + _OFFSETS).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for minima in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _STEP + minima)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two shingle sets is as high; never that of two empty sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both + 1e-9 >= similarity * (len(a) + len(b) - both)


def _raw(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "").cast(pa.large_binary())


def _keys_of(text: Column, words: int) -> Column:
    def keyed(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py(), words) for t in _raw(texts))
        return pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))

    return F.arrow_udf(keyed, "array<long>")(text.cast("string"))


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs a, b whose texts are similar, stashed. Only texts of rows in a pair are moved."""

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        pair = zip(_raw(left), _raw(right))
        return pa.array([similar(shingle_set(x.as_py(), words), shingle_set(y.as_py(), words), similarity) for x, y in pair], pa.bool_())

    rows = stash(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    held = stash(texts.join(rows, "row", "left_semi"))
    left = held.select(F.col("row").alias("a"), F.col("text").alias("left"))
    right = held.select(F.col("row").alias("b"), F.col("text").alias("right"))
    return stash(pairs.select("a", "b").join(left, "a").join(right, "b").where(alike("left", "right")).select("a", "b"))


def similar_links(texts: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, among: DataFrame | None = None) -> DataFrame:
    """Links a, b between rows of texts(row long, text string) that connect similar texts; row is distinct.

    Of the rows, those of among(row) count, if given: keys are joined to it, so texts stay where they are.
    """
    keyed = stash(texts.select("row", _keys_of(F.col("text"), words).alias("keys")))
    if among is not None:
        keyed = keyed.join(among, "row", "left_semi")
    members = keyed.select("row", F.explode("keys").alias("key"))
    groups = stash(members.groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last"))
    ends = F.array(F.struct(F.col("first").alias("a"), F.col("row").alias("b")), F.struct(F.col("row").alias("a"), F.col("last").alias("b")))
    met = members.join(groups, "key").select(F.inline(ends)).where("a < b")
    pairs = stash(met.groupBy("a", "b").agg(F.count("*").alias("n")))
    tried = stash(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))
    links = _confirmed(tried, texts, similarity, words)
    roots = connected_components(links)
    root_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    root_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    rest = pairs.select("a", "b").join(tried, ["a", "b"], "left_anti").join(root_a, "a", "left").join(root_b, "b", "left")
    apart = F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))
    return links.unionByName(_confirmed(stash(rest.where(apart).select("a", "b")), texts, similarity, words))


def surplus(docs: DataFrame, similarity: float = SIMILARITY, among: DataFrame | None = None) -> DataFrame:
    """The rows of docs(row, doc_id, text), or of those among(row), that go if one of each group of near copies stays: that of the
    smallest doc_id, null ids last, then of the smallest row."""
    roots = connected_components(similar_links(docs.select("row", "text"), similarity, among=among))
    tied = stash(docs.select("row", "doc_id").join(roots.withColumnRenamed("node", "row"), "row"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = tied.groupBy("root").agg(F.min_by("row", order).alias("row")).select("row")
    return stash(tied.select("row").join(stays, "row", "left_anti"))
