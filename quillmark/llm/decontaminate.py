"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are its runs of WINDOW words (one shorter window if it has fewer). The words
of a window are ordered by rarity, by how often they stand in all documents, counted in
BUCKETS of hashed words. To hold a window exactly, a document must hold its rarest word, so
the necessary prefix is that word: only places of such words are candidates. A word's bucket
says in which shapes it is met, that is at which place in windows of which length. By these
the window's begin follows from the place of the word (positional bound), and it must lie
within the document (length bound). What such a place would hold is hashed, sifted by a
bitmap of all windows' hashes, and what remains is joined to the windows by the SHA-256 of
its words. The bitmap and the shapes have fixed sizes, whatever the benchmark's; windows and
candidates are tables. A hot window is salted if there are more than BROADCAST_WINDOWS.

Null and empty texts have no words and hit nothing; an item without words has no window.
Repeated items count once by their id, null ids not at all. Repeated documents are judged one
by one. A very long text takes memory for its words once and for 40 bytes for each window that
it holds. No documents give no rows. Other columns of either input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices_of, stash

WINDOW, BROADCAST_WINDOWS, SALTS = 13, 100_000, 16
#: Buckets of words, and bits of the map of windows.
BUCKETS, MAP_BITS = 1 << 18, 1 << 23
SLICE_BYTES = 4 << 20
#: A-Z lower-cased, a zero for each byte that is in no word. Bytes from 128 make up the characters beyond ASCII.
_WORD_BYTES = np.array([c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0 for c in range(128)] + list(range(128, 256)), np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in UTF-8, lower-cased, and where each text's words begin; one more place for the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = _WORD_BYTES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    inside = raw > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1] - offsets[0]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]  # words end with their text
    bare = np.cumsum(inside) - inside  # bytes of words before each byte
    at = np.flatnonzero(begins)
    ends = np.concatenate([bare[at], [np.count_nonzero(inside)]]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    return words, np.searchsorted(at, offsets - offsets[0])


def buckets_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) % BUCKETS for w in words), np.int64, len(words))


def _map_bit(window: bytes) -> int:
    return xxhash.xxh64_intdigest(window, 1) % MAP_BITS


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, digest, bit, buckets (of its words, in their order) of each window of each item."""

    def cut(batches):
        for batch in batches:
            for lo, hi in slices_of(batch.column(1), SLICE_BYTES):
                words, offsets = words_of(batch.column(1).slice(lo, hi - lo))
                words, ids = words.to_pylist(), batch.column(0).slice(lo, hi - lo).to_pylist()
                found = []
                for i, item in enumerate(ids):
                    own = words[offsets[i] : offsets[i + 1]]
                    kinds = buckets_of(own).tolist()
                    for k in range(max(1, len(own) - size + 1) if own else 0):
                        window = b" ".join(own[k : k + size])
                        found.append((item, hashlib.sha256(window).digest(), _map_bit(window), kinds[k : k + size]))
                columns = list(zip(*found)) or [()] * 4
                types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["item_id", "digest", "bit", "buckets"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item_id long, digest binary, bit int, buckets array<int>")


def _bits(df: DataFrame, column: str, size: int) -> np.ndarray:
    """A map with a bit for each value of the column; `size` rows at most reach the driver."""
    out = np.zeros(size, bool)
    out[[r[0] for r in df.select(column).distinct().collect()]] = True
    return out


def corpus_counts(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often words of each wanted bucket stand in all documents; a task sends a row a bucket at most."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def counted(batches):
        totals, among = np.zeros(BUCKETS, np.int64), np.unpackbits(held.value).astype(bool)
        for batch in batches:
            for lo, hi in slices_of(batch.column(0), SLICE_BYTES):
                coded = words_of(batch.column(0).slice(lo, hi - lo))[0].dictionary_encode()
                np.add.at(totals, buckets_of(coded.dictionary.to_pylist()), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        at = np.flatnonzero(totals * among)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def _rarest(counts: np.ndarray):
    """A function of windows' buckets: the bucket that is rarest in all documents, its place, the length."""

    @F.arrow_udf("bucket int, place int, size int")
    def rarest(windows: pa.Array) -> pa.Array:
        found = []
        for w in windows.to_pylist():
            place = min(range(len(w)), key=lambda i: (counts[w[i]], w[i], i))
            found.append((w[place], place, len(w)))
        columns = list(zip(*found)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(list(c), pa.int32()) for c in columns], names=["bucket", "place", "size"])

    return rarest


def _candidates(docs: DataFrame, shapes: dict[int, list[tuple[int, int]]], window_bits: np.ndarray) -> Column:
    """Of each `text` of docs the struct n_words, found: begin, length and digest of what may be a window."""
    held = docs.sparkSession.sparkContext.broadcast((shapes, np.packbits(window_bits)))  # both of fixed size at most

    def scanned(texts: pa.Array) -> pa.Array:
        known, packed = held.value
        met = np.zeros(BUCKETS, bool)
        met[list(known)] = True
        sizes, found = [], []
        for lo, hi in slices_of(texts, SLICE_BYTES):
            words, offsets = words_of(texts.slice(lo, hi - lo))
            coded = words.dictionary_encode()
            buckets = buckets_of(coded.dictionary.to_pylist())
            codes = coded.indices.to_numpy()
            at = np.flatnonzero(met[buckets][codes]) if len(codes) else np.zeros(0, np.int64)
            of = np.searchsorted(offsets, at, side="right") - 1
            each: dict[int, list[dict]] = {}
            for k, i in zip(at.tolist(), of.tolist()):
                for place, size in known[int(buckets[codes[k]])]:
                    begin = k - place
                    if begin < offsets[i] or begin + size > offsets[i + 1]:
                        continue
                    window = b" ".join(words.slice(begin, size).to_pylist())
                    bit = _map_bit(window)
                    if packed[bit >> 3] >> (7 - (bit & 7)) & 1:
                        each.setdefault(i, []).append({"begin": begin - int(offsets[i]), "size": size, "digest": hashlib.sha256(window).digest()})
            sizes += np.diff(offsets).tolist()
            found += [each.get(i, []) for i in range(hi - lo)]
        spans = pa.list_(pa.struct([("begin", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(found, spans)], names=["n_words", "found"])

    return F.arrow_udf(scanned, "n_words long, found array<struct<begin: long, size: long, digest: binary>>")(F.col("text").cast("string"))


def _scanned(docs: DataFrame, benchmark: DataFrame, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """The columns to keep with row, n_words, found of each document, stashed; and digest, items of each window."""
    windows = stash(benchmark_windows(benchmark))
    counts = corpus_counts(docs, _bits(windows.select(F.explode("buckets").alias("bucket")), "bucket", BUCKETS))
    shaped = windows.select("buckets").distinct().select(_rarest(counts)("buckets").alias("s")).select("s.*").distinct()
    shapes: dict[int, list[tuple[int, int]]] = {}
    for r in shaped.collect():  # BUCKETS x shapes rows at most
        shapes.setdefault(r.bucket, []).append((r.place, r.size))
    scan = docs.select(*keep, _candidates(docs, shapes, _bits(windows, "bit", MAP_BITS)).alias("scan"), F.monotonically_increasing_id().alias("row"))
    owned = windows.groupBy("digest").agg(F.collect_set("item_id").alias("items"))  # of benchmark items that share a window
    return stash(scan.select(*scan.drop("scan").columns, "scan.*")), stash(owned)


def _hits(scan: DataFrame, windows: DataFrame) -> DataFrame:
    """row, n_hit, n_items, items_sha256 of the documents that hold a window."""
    found = scan.select("row", F.inline("found"))
    if windows.count() <= BROADCAST_WINDOWS:
        hits = found.join(F.broadcast(windows), "digest")
    else:
        salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("row", "begin"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    spans = F.sort_array(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))

    def further(so_far: Column, span: Column) -> Column:
        gain = F.greatest(F.lit(0).cast("long"), span["end"] - F.greatest(span["begin"], so_far["reach"]))
        return F.struct((so_far["total"] + gain).alias("total"), F.greatest(so_far["reach"], span["end"]).alias("reach"))

    covered = hits.groupBy("row").agg(spans.alias("spans")).select("row", F.aggregate("spans", start, further)["total"].alias("n_hit"))
    owners = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    owned = owners.select("row", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return covered.join(owned, "row", "left").select("row", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def leaks_by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan, windows = _scanned(docs, benchmark, F.col("doc_id"))
    met = scan.drop("found").join(stash(_hits(scan, windows)), "row", "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return met.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated."""
    scan, windows = _scanned(docs, benchmark, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    bad = scan.select("row", "n_words").join(_hits(scan, windows), "row").where(_contaminated(F.col("n_hit"), F.col("n_words"))).select("row")
    return scan.join(stash(bad), "row", "left_anti").select("doc.*")
