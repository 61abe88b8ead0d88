"""Language-model scoring by cross-entropy difference.

A target model, of trusted documents, and a background model, of all documents, are bigram
models over one vocabulary: all words of all documents. Both count all bigrams. With c for
counts, V for the words, the start of a text and one symbol for words never seen,

    P(w | h) = PAIR_WEIGHT c(h, w) / c(h) + (1 - PAIR_WEIGHT) (c(w) + 1) / (N + V),

and the second term alone, without its weight, where h was never followed. The score is the
mean over the words of the target's loss less the background's: low scores are like the
target. Words are runs without ASCII white space, A-Z lower-cased.

No table of counts is held whole. Documents are cut into chunks of about _CHUNK_BYTES; a chunk
sends each of its words and pairs once, by a 63-bit hash, to the bucket of the hash's first
bits, which adds up what all chunks sent and returns each chunk its own grams' totals. A frequent gram costs a bucket one number a chunk, and buckets grow in number with the
words, so neither grows with the corpus. Two grams of one hash would count together.

The target is made of all documents with a label of good quality that is not toxic.

Null, empty and blank texts have 0 words, losses and score. Without target documents the
target model is uniform. Repeated rows stay, each scored for itself, and all of them count.
No documents give no rows; a very long text makes a chunk of its own, which is held whole.
Other columns of the inputs are not read.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of, stash

PAIR_WEIGHT = 0.7
#: Bytes of text of a chunk, and words of the corpus for each bucket of grams.
_CHUNK_BYTES, _BUCKET_WORDS = 4 << 20, 1 << 20
#: The hash of the start of a text, and what sets pairs apart from words.
_START, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x8CB92BA72F3D8DD7)
#: What is counted of a gram: all, the target's; of words also as the first of a pair.
_COUNTED = ["n", "t", "n_first", "t_first"]
_CHUNK = "chunk long, ids array<long>, lengths binary, codes binary, hashes binary, n_words long"
_GRAMS = "bucket int, chunk long, keys binary, n binary, t binary, n_first binary, t_first binary"
_TOTALS = "chunk long, bucket int, n binary, t binary, n_first binary, t_first binary, n_distinct long"
_SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts and where each text's words begin; one more place for the end."""
    # Lowered before the cast: Arrow lowers a slice that was cast to zero bytes.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    offsets, words = lists.offsets.to_numpy(), lists.values
    real = pc.not_equal(words, "")
    return words.filter(real), np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[offsets]


def _packed(numbers: np.ndarray) -> bytes:
    """All first bytes of the numbers, all second ones and so on to the last that is not zero, compressed."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = int(numbers.max(initial=0)).bit_length() + 7 >> 3
    data = planes[:used].tobytes()
    return bytes([used]) + len(numbers).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _unpacked(data: bytes) -> np.ndarray:
    used, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if used and n:
        out[:, :used] = np.frombuffer(pa.decompress(data[9:], used * n, codec="zstd"), np.uint8).reshape(used, n).T
    return out.view("<i8").ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents in chunks: their ids, numbers of words, the words as places in the chunk's own list, and its hashes."""

    def cut(batches):
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi in slices_of(batch.column(1), _CHUNK_BYTES):
                words, offsets = _words(batch.column(1).slice(lo, hi - lo))
                coded = words.dictionary_encode()
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], "<u8")
                columns = [[next(number)], [ids.slice(lo, hi - lo).to_pylist()], [_packed(np.diff(offsets))], [_packed(coded.indices.to_numpy())], [hashes.tobytes()], [len(words)]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "ids", "lengths", "codes", "hashes", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(cut, _CHUNK)


class Grams:
    """A chunk's grams: the start of a text, its words, then its pairs."""

    def __init__(self, lengths: bytes, codes: bytes, hashes: bytes):
        self.lengths = _unpacked(lengths)
        self.now = (_unpacked(codes) + 1).astype(np.int32)
        self.before = np.concatenate([[0], self.now[:-1]]).astype(np.int32)[: len(self.now)]
        self.before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = 0
        words = np.concatenate([[_START], np.frombuffer(hashes, "<u8")])
        self.n_words = len(words)
        pairs, pair = np.unique(self.before * np.int64(self.n_words) + self.now, return_inverse=True)
        self.pair = pair.astype(np.int32)
        keys = _mixed(_mixed(words[pairs // self.n_words] + _PAIR) + words[pairs % self.n_words])
        keys = np.concatenate([words | np.uint64(1), keys & ~np.uint64(1)])
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        #: Ascending; odd for words and the start, even for pairs.
        self.keys = keys[self.order]

    def counts(self, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How often each key's gram stands here, and stands first in a pair, in words of the given weights."""
        n_pairs = len(self.order) - self.n_words
        alone = np.concatenate([np.bincount(self.now, weights, self.n_words), np.bincount(self.pair, weights, n_pairs)])
        first = np.concatenate([np.bincount(self.before, weights, self.n_words), np.zeros(n_pairs)])
        return alone.astype(np.int64)[self.order], first.astype(np.int64)[self.order]

    def losses(self, totals: np.ndarray, firsts: np.ndarray, of_all: int, size: int) -> np.ndarray:
        """Of each word, from the totals of all keys, those of all words and the vocabulary's size."""
        grams, contexts = np.empty(len(totals)), np.empty(len(totals))
        grams[self.order], contexts[self.order] = totals, firsts
        c = contexts[self.before]
        rest = np.where(c > 0, 1 - PAIR_WEIGHT, 1) * (grams[self.now] + 1) / (of_all + size)
        return -np.log(PAIR_WEIGHT * grams[self.n_words :][self.pair] / np.maximum(c, 1) + rest)


def _flagged(chunks: DataFrame, good: DataFrame) -> DataFrame:
    """chunks with `targets`, the places of those of their documents that are among the good ones."""
    each = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id"))
    found = stash(each.join(good, "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("targets")))
    return chunks.join(found, "chunk", "left")  # a row a chunk on both sides


def _gram_totals(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket and the totals of _COUNTED of the chunk's keys in the bucket, in their order.

    n_distinct is how many words, the start among them, the bucket has, in one of its rows."""

    def dealt(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams = Grams(row["lengths"], row["codes"], row["hashes"])
                target = np.zeros(len(grams.lengths))
                target[row["targets"] or []] = 1
                (n, n_first), (t, t_first) = grams.counts(), grams.counts(np.repeat(target, grams.lengths))
                ends = np.searchsorted(grams.keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else []
                parts = [(lo, hi) for lo, hi in zip([0, *ends], [*ends, len(n)])]
                columns = [range(len(parts)), [row["chunk"]] * len(parts), [_packed(np.diff(grams.keys[lo:hi], prepend=np.uint64(0))) for lo, hi in parts]]
                columns += [[_packed(x[lo:hi]) for lo, hi in parts] for x in (n, t, n_first, t_first)]
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "chunk", "keys", *_COUNTED])

    def summed(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(x).view("<u8"), dtype="<u8") for x in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        columns = [table.column("chunk"), table.column("bucket")]
        for name in _COUNTED:
            sums = np.bincount(at, np.concatenate([_unpacked(x) for x in table.column(name).to_pylist()]), len(found)).astype(np.int64)
            columns.append(pa.array([_packed(x) for x in np.split(sums[at], ends)], pa.binary()))
        distinct = [int((found & np.uint64(1)).sum()), *[0] * (len(keys) - 1)]
        return pa.table([*columns, pa.array(distinct, pa.int64())], names=["chunk", "bucket", *_COUNTED, "n_distinct"])

    return chunks.select("chunk", "lengths", "codes", "hashes", "targets").mapInArrow(dealt, _GRAMS).groupBy("bucket").applyInArrow(summed, _TOTALS)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score for every row of docs."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long")).distinct()
    chunks = stash(_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
    flagged = _flagged(chunks, good)
    of_all = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    totals = stash(_gram_totals(flagged, (of_all // _BUCKET_WORDS).bit_length()))
    size = totals.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0] + 1  # with one symbol for words never seen
    of_target = _target_words(flagged)

    def scored(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        row, parts = chunk.to_pylist()[0], totals.sort_by("bucket")
        grams = Grams(row["lengths"], row["codes"], row["hashes"])
        n, t, n_first, t_first = (np.concatenate([_unpacked(x) for x in parts.column(c).to_pylist()]) for c in _COUNTED)
        of = np.repeat(np.arange(len(grams.lengths)), grams.lengths)
        losses = grams.losses(t, t_first, of_target, size), grams.losses(n, n_first, of_all, size)
        target, background = (np.bincount(of, x, len(grams.lengths)) / np.maximum(grams.lengths, 1) for x in losses)
        columns = [pa.array(row["ids"], pa.int64()), *map(pa.array, (grams.lengths, target, background, target - background))]
        return pa.table(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    texts = chunks.select("chunk", "ids", "lengths", "codes", "hashes").groupBy("chunk")
    return texts.cogroup(totals.select("chunk", "bucket", *_COUNTED).groupBy("chunk")).applyInArrow(scored, _SCORES)


def _target_words(flagged: DataFrame) -> int:
    """Words of all target documents."""

    def counted(batches):
        for batch in batches:
            sums = [int(_unpacked(r["lengths"])[r["targets"] or []].sum()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["n"])

    return flagged.select("lengths", "targets").mapInArrow(counted, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
