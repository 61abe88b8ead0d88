"""Tabular JSON documents: an envelope of licence, description, sources and schema around rows of mixed cells."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import Field, Table

LICENSE = "CC0-1.0"
#: Top-level members that a document must have.
MEMBERS = ("license", "description", "sources", "schema", "data")


def record_json(*columns: str) -> Column:
    """The cells of a row as one compact JSON array; null cells are kept."""
    return F.to_json(F.array(*(F.col(c).cast("variant") for c in columns)))


def document(table: Table, rows: DataFrame, sources: str, description: dict | str, order: str | None = None) -> DataFrame:
    """One row, `content`: the whole document, which is published as one object. Rows keep their order."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(place.alias("pos"), record_json(*table.names()).alias("r")))).alias("rows"))
    head = json.dumps({"license": LICENSE, "description": description, "sources": sources, "schema": {"fields": [f.described() for f in table.fields]}}, ensure_ascii=False)
    return listed.select(F.concat(F.lit(head[:-1] + ', "data": ['), F.array_join(F.transform("rows", lambda r: r["r"]), ","), F.lit("]}")).alias("content"))


def read_rows(texts: DataFrame, fields: tuple[Field, ...], column: str = "content") -> DataFrame:
    """pos and the declared columns of each row of the documents; a document that lacks a member is an error.

    A row that is too short has nulls at its end."""
    v = F.parse_json(F.col(column))
    whole = [F.variant_get(v, f"$.{m}", "variant").isNotNull() for m in MEMBERS]
    checked = F.when(F.array_contains(F.array(*whole), F.lit(False)), F.raise_error(F.lit("the document lacks one of " + ", ".join(MEMBERS)))).otherwise(F.variant_get(v, "$.data", "array<variant>"))
    rows = texts.select(F.posexplode(checked).alias("pos", "row"))
    cells = [F.variant_get("row", f"$[{i}]", f.column_type()).alias(f.name) for i, f in enumerate(fields)]
    return rows.select(F.col("pos").cast("long").alias("pos"), *cells)
