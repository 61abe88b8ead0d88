"""Reading, intermediate tables and bounded samples shared by the operators."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; Spark opens the path, so any store that it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    folder = tempfile.TemporaryDirectory(prefix="quillmark-")
    atexit.register(folder.cleanup)
    return f"file://{folder.name}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where one machine is all there is, a folder
    of our own will do; on a cluster spark.checkpoint.dir must be set."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


#: Folders of the stashes made in each open scratch().
_open: list[list[str]] = []


def _remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(where) if at_exit else store.delete(where, True)


def new_folder(spark: SparkSession, kind: str = "quillmark") -> str:
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def stash(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and return a reader of them.

    A lost executor costs no recomputation of what lies behind, and rows that two branches use are
    computed once. The folder goes with the driver's process, or with the scratch() around."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.parquet(path)
    _remove(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are made inside are removed at its end."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n distinct non-null keys whose hash is smallest: bounded, repeatable, blind to order."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("_one"))
    return keys.select(key).orderBy(F.xxhash64(key), key).limit(n)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices_of(texts: pa.Array, most_bytes: int = 8 << 20):
    """(start, stop) ranges of rows whose texts take about most_bytes together, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
