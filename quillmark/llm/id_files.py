"""Token ids of a corpus in files of range-coded segments (see range_coder), and back.

Documents are dealt by ranges of doc_id, so that files follow each other in ascending order,
and encoded; each id list ends with END_ID. A row of a file is a segment: `part` and `seq`
say where it stands, `start` how many ids its part has before it, `doc_ids` and `sizes` whose
ids it holds, `data` the coded ids. A segment holds whole documents, of SEGMENT_IDS ids
together if they are not larger. Files are Parquet, so that tasks that are run again commit
once and every store that Spark knows will do.

Null and empty texts have the end id alone. Rows with the same doc_id follow each other in the
order of their texts' hashes; null ids come first. Other columns of the input are not read.
No documents make no segments. A segment is coded in one task, in about 20 bytes an id and 10 MB
of models: less than 100 MB, unless one document alone is larger.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, slices_of
from .pieces import SLICE_BYTES, encoder
from .range_coder import decode_segment, encode_segment

END_ID, SEGMENT_IDS = 0, 1 << 22
#: Pieces that a generation of known ones holds; two are held.
_GENERATION = 1 << 18
SEGMENTS = "part int, seq int, start long, n_ids long, doc_ids array<long>, sizes array<long>, data binary"


def _segments(slices: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Whole documents of at most so many ids, one document at least: their doc_ids, sizes and ids, as the slices have them."""
    held, room = [], most
    for names, sizes, ids in slices:
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            begin = int(ends[first] - sizes[first])
            last = max(int(np.searchsorted(ends, begin + room, "right")), first + (not held))
            if last > first:
                held.append((names.slice(first, last - first), sizes[first:last], ids[begin : ends[last - 1]]))
                first, room = last, room - int(ends[last - 1] - begin)
            if first < len(sizes):
                yield _joined(held)
                held, room = [], most
    if held:
        yield _joined(held)


def _joined(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    names, sizes, ids = zip(*held)
    return pa.concat_arrays(names), np.concatenate(sizes), np.concatenate(ids)


def write_ids(docs: DataFrame, tokenizer: str, path: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every document and write the files."""

    def slices(batches):
        enc = encoder(tokenizer, _GENERATION)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices_of(texts, SLICE_BYTES):
                ids, sizes = enc.encode(texts.slice(lo, hi - lo))
                yield batch.column(0).slice(lo, hi - lo), sizes + 1, np.insert(ids, np.cumsum(sizes), END_ID)

    def encoded(batches):
        part, start = TaskContext.get().partitionId(), 0
        for seq, (names, sizes, ids) in enumerate(_segments(slices(batches), segment_ids)):
            row = [part, seq, start, len(ids), names.to_pylist(), sizes.tolist(), encode_segment(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SEGMENTS.split(", ")])
            start += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(encoded, SEGMENTS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    before, total = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # a row for each file
        before[r.part], total = total, total + r.n

    def decoded(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(decode_segment(r["data"]).astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                start = before[r["part"]] + r["start"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "start", "doc_ids", "sizes", "data").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def through_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids to a new folder of the shared one and read them back."""
    path = new_folder(docs.sparkSession, "quillmark-ids")
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
