"""Members of zip archives as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where a root folder has its archive and its version.
ARCHIVE, VERSION = "data/databundles/scripts.zip", "version.txt"


class MemberNotFound(LookupError):
    """An archive has no member of this name."""


def members(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """path, name, content (UTF-8) of the named members of all archives under a path, or of all members."""
    wanted = frozenset(names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(data.as_buffer())) as z:
                    for info in z.infolist():
                        if not info.is_dir() and (not wanted or info.filename in wanted):
                            yield pa.RecordBatch.from_pydict({"path": [place], "name": [info.filename], "content": [z.read(info).decode()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, name string, content string")


def member_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row, `content`: that member of one archive."""
    found = members(spark, path, name).select("content")
    if found.isEmpty():
        raise MemberNotFound(f"{path} has no {name}")
    return found


def version_of(spark: SparkSession, root: str) -> str:
    """The root folder's version, or `unknown`."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(f"{root}/{VERSION}", wholetext=True).first()
    except AnalysisException:
        return "unknown"
    return row.value.strip() if row else "unknown"


def sources_text(version: str) -> str:
    return f"Extract data from patch {version}"
