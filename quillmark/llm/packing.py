"""Packing into sequences by non-negative least squares over the histogram of lengths.

A document's ids are cut into windows of SEQUENCE ids and a rest. Each window is a sequence.
For the rests, combinations of two or three lengths that fill a window exactly are enumerated;
non-negative least squares finds how often to use each so that the histogram of rests is used
up; the counts are rounded to what the histogram holds. A rest takes the place that its rank
among all rests of its length leads to. The rests that no combination takes are packed greedily,
in the partition that read them, and cut where a sequence is full; cuts lie at multiples of GRID
ids, where running checksums are kept, so no text is encoded twice.

Null and empty texts have the end id alone. Repeated rows are packed one by one, a null doc_id
like any other. Other columns of the input are not read. No documents give no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices_of, stash
from .pieces import SLICE_BYTES, encoder

SEQUENCE, END_ID, GRID = 2048, 1, 64
#: Lengths that triples are built with besides any first length, and rounds of the solver.
FREQUENT, ROUNDS = 24, 300
#: Sequence ids from here on belong to partitions: LOCAL + partition * PARTITION_IDS + number.
LOCAL, PARTITION_IDS = 1 << 62, 1 << 31
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: memoryview, lo: int, hi: int, before: int = 0) -> int:
    return zlib.crc32(ids[4 * lo : 4 * hi], before)


def measure(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n, the checksums of full windows, the rest's running checksums at GRID, row."""

    def measured(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices_of(texts, SLICE_BYTES):
                ids, sizes = enc.encode(texts.slice(lo, hi - lo))
                ends = np.cumsum(sizes)
                raw = memoryview(np.insert(ids, ends, END_ID).astype("<u4").tobytes())
                windows, running, at = [], [], 0
                for n in sizes + 1:
                    full = int(n) // SEQUENCE * SEQUENCE
                    windows.append([_crc(raw, at + k, at + k + SEQUENCE) for k in range(0, full, SEQUENCE)])
                    crc, rest = 0, [0]
                    for k in range(full, int(n), GRID):
                        rest.append(crc := _crc(raw, at + k, at + min(k + GRID, int(n)), crc))
                    running.append(np.array(rest, "<u4").tobytes())
                    at += int(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes + 1), pa.array(windows, pa.list_(pa.int64())), pa.array(running, pa.binary())], names=["doc_id", "n", "windows", "running"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measured, "doc_id long, n long, windows array<long>, running binary")
    return stash(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a window and that the histogram has."""
    size = len(histogram)
    has = np.flatnonzero(histogram)
    pairs = np.stack([has, size - has, np.zeros_like(has)], axis=1)
    often = has[np.argsort(-histogram[has], kind="stable")[:FREQUENT]]
    a, b = (x.ravel() for x in np.meshgrid(has, often))
    triples = np.stack([a, b, size - a - b], axis=1)[size - a - b > 0]
    found = np.unique(np.sort(np.concatenate([pairs, triples]), axis=1)[:, ::-1], axis=0)
    return found[(histogram[found] > 0).sum(axis=1) == (found > 0).sum(axis=1)]


def least_squares(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that makes sum(x * combos) close to the histogram: gradient steps, each scaled by
    the column's overlap with all columns, which never raises the error; negatives become 0."""
    used = combos > 0
    size = len(histogram)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), weights=np.where(used, x[:, None], 0).ravel(), minlength=size)

    overlap = (total(used.sum(axis=1).astype(float))[combos] * used).sum(axis=1)
    x = np.zeros(len(combos))
    for _ in range(ROUNDS):
        miss = (histogram - total(x))[combos] * used
        x = np.maximum(0, x + miss.sum(axis=1) / np.maximum(overlap, 1))
    return x


@dataclass
class Plan:
    """Places for rests: segment s takes those of its length whose rank is below `ends` and not below `key`'s."""

    keys: np.ndarray  # length << 40 | first rank, ascending
    ends: np.ndarray  # rank behind the last
    sequence: np.ndarray  # of the first rank
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each rest has a place, its sequence and its offset there."""
        if not len(self.keys):
            return np.zeros(len(lengths), bool), np.zeros_like(lengths), np.zeros_like(lengths)
        at = np.maximum(np.searchsorted(self.keys, lengths << 40 | ranks, side="right") - 1, 0)
        first = self.keys[at] & ((1 << 40) - 1)
        placed = (self.keys[at] >> 40 == lengths) & (first <= ranks) & (ranks < self.ends[at])
        return placed, self.sequence[at] + ranks - first, self.offset[at]


def plan_sequences(counts: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Solve the repeat counts, round them to what there is and lay out the segments."""
    histogram = np.zeros(size, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    combos = combinations(histogram) if histogram.any() else np.zeros((0, 3), np.int64)
    x = least_squares(combos, histogram) if len(combos) else np.zeros(0)
    left, times = histogram.copy(), np.zeros(len(combos), np.int64)
    order = np.argsort(-x, kind="stable")
    for wanted in (np.floor(x), np.full(len(x), np.inf)):  # the rounded counts, then what still fits
        for c in order:
            lengths = combos[c][combos[c] > 0]
            uniq, each = np.unique(lengths, return_counts=True)
            n = int(min(wanted[c], (left[uniq] // each).min()))
            if n > 0:
                left[uniq] -= n * each
                times[c] += n
    segments, taken, sequence = [], defaultdict(int), 0
    for c in np.flatnonzero(times):
        offset = 0
        for length in map(int, combos[c][combos[c] > 0]):
            segments.append((length << 40 | taken[length], taken[length] + int(times[c]), sequence, offset))
            taken[length] += int(times[c])
            offset += length
        sequence += int(times[c])
    table = np.array(sorted(segments), np.int64).reshape(-1, 4)
    return Plan(*(table[:, k] for k in range(4)), sequence)


def _rest_crc(running: np.ndarray, lo: int, hi: int) -> int:
    """The checksum of the rest's ids lo..hi, from those of what ends at lo and at hi."""
    zeros = bytes(4 * (hi - lo))
    return int(running[-(-hi // GRID)]) ^ zlib.crc32(zeros, int(running[lo // GRID])) ^ zlib.crc32(zeros)


def _placed(rows: pd.DataFrame, before: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """All pieces of one partition's documents; before: rests of each length in earlier partitions."""
    rows = rows.sort_values("row", ignore_index=True)
    if rows.empty:
        return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in PIECES.split(", ")})
    ids = LOCAL + int(rows["part"].iloc[0]) * PARTITION_IDS
    ids_used, out = 0, []
    n, rest = rows["n"].to_numpy(np.int64), rows["n"].to_numpy(np.int64) % SEQUENCE
    rank = pd.Series(rest).groupby(rest).cumcount().to_numpy() + pd.Series(rest).map(dict(zip(before["rest"], before["earlier"]))).fillna(0).to_numpy(np.int64)
    has_place, sequence, offset = plan.place(rest, rank)
    room, open_ = 0, ids  # of the local sequence that is being filled
    for i, (windows, running) in enumerate(zip(rows["windows"], rows["running"])):
        for k, crc in enumerate(windows):
            out.append((i, k * SEQUENCE, SEQUENCE, crc, ids + ids_used, 0))
            ids_used += 1
        start, length = int(n[i] - rest[i]), int(rest[i])
        if not length:
            continue
        running = np.frombuffer(running, "<u4")
        if has_place[i]:
            out.append((i, start, length, int(running[-1]), int(sequence[i]), int(offset[i])))
            continue
        at = 0
        while at < length:
            piece = length - at if length - at <= room else room // GRID * GRID
            if not piece:
                room, open_ = SEQUENCE, ids + ids_used
                ids_used += 1
                continue
            out.append((i, start + at, piece, _rest_crc(running, at, at + piece), open_, SEQUENCE - room))
            room, at = room - piece, at + piece
    i, *columns = (np.array(c, np.int64) for c in zip(*out))
    start, length, crc, sequence_id, place = columns
    return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").to_numpy()[i] if rows["doc_id"].isna().any() else rows["doc_id"].to_numpy(np.int64)[i], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": n[i], "sequence_id": sequence_id, "offset": place})


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows = measure(docs, tokenizer)
    rest = (F.col("n") % SEQUENCE).alias("rest")
    counts = stash(rows.select("part", rest).where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("c")))
    histogram = {r.rest: r.c for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # SEQUENCE - 1 rows at most
    plan = plan_sequences(histogram)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "rest", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("earlier"))
    return rows.groupBy("part").cogroup(before.groupBy("part")).applyInPandas(lambda a, b: _placed(a, b, plan), PIECES)
