"""Lookups in keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """key, value: of several rows of a key the last counts; null keys are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, pos).alias(value))


def first_wins(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, pos).alias(value))


def find_record(df: DataFrame, column: str, value: object, pos: str) -> DataFrame:
    """The first row whose cell equals the value; none for an unknown column."""
    if column not in df.columns:
        return df.limit(0)
    return df.where(F.col(column).eqNullSafe(F.lit(value))).orderBy(pos).limit(1)


def find_index(df: DataFrame, column: str, value: object, pos: str) -> DataFrame:
    """The place of that row; no row if there is none."""
    return find_record(df, column, value, pos).select(pos)


def find_place(df: DataFrame, column: str, value: object, *order: str) -> DataFrame:
    """pos: the 0-based place, in that order, of the first row whose cell equals the value; no row if there is none.

    The rows before it are counted; nothing is sorted or numbered. The order must tell rows apart."""
    place = F.struct(*order)
    first = df.where(F.col(column).eqNullSafe(F.lit(value))).agg(F.min(place).alias("_first")).where("_first is not null")
    counted = df.select(place.alias("_place")).crossJoin(F.broadcast(first))  # one row
    return counted.agg(F.count_if(F.col("_place") < F.col("_first")).alias("pos"), F.count("*").alias("_any")).where("_any > 0").select("pos")


def with_fallbacks(df: DataFrame, dim: DataFrame, key: str, value: str, only: str, others: Sequence[str], prefix: str = "", to: str | None = None) -> DataFrame:
    """df with the value looked up by the upper-cased column `only` if that is not null, else by the
    first of the others that has one. The table has a row for each key; Spark picks the join."""
    found = {}
    for i, c in enumerate([only, *others]):
        side = dim.select(F.col(key).alias(f"_key{i}"), F.col(value).alias(f"_value{i}"))
        df = df.join(side, F.concat(F.lit(prefix), F.upper(F.col(c))) == F.col(f"_key{i}"), "left").drop(f"_key{i}")
        found[i] = F.col(f"_value{i}")
    result = F.when(F.col(only).isNotNull(), found[0]).otherwise(F.coalesce(*(found[i] for i in range(1, len(found)))))
    return df.withColumn(to or value, result).drop(*(f"_value{i}" for i in found))


def resolve_constant(name: Column, values: dict[str, object]) -> Column:
    """The value of a name in a fixed table; null for an unknown name."""
    return F.try_element_at(F.create_map(*(F.lit(x) for item in values.items() for x in item)), name)


def nested_names(df: DataFrame, bucket: str, key: str, members: Sequence[str], pos: str) -> DataFrame:
    """bucket, names: a map from key to a struct of the members, last row wins, sorted by key.

    The map holds all keys of its bucket, so a bucket is meant to be a published object."""
    row = F.struct(*members)
    one = df.where(F.col(bucket).isNotNull()).groupBy(bucket, key).agg(F.max_by(row, F.col(pos)).alias("v"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(key), F.col("v"))))
    return one.groupBy(bucket).agg(F.map_from_entries(entries).alias("names"))
