"""New tables merged with their history, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import OVERWRITE, Policy


def first_by(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key. Only the row that wins leaves a task."""
    row = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.min_by(row, F.col(pos)).alias("_row")).select(key, "_row.*")


def _sides(new: DataFrame, old: DataFrame, key: str, how: str, pos: str) -> DataFrame:
    """Rows of both sides as the structs n and h, matched null-safely; h is the first of its key."""
    n = new.select(F.struct(*new.columns).alias("n"))
    h = first_by(old, key, pos).select(F.struct(*old.columns).alias("h"))
    return n.join(h, F.col(f"n.{key}").eqNullSafe(F.col(f"h.{key}")), how)


def _merged(name: str, key: str, policies: dict[str, Policy], old_names: list[str]) -> Column:
    new, policy = F.col(f"n.{name}"), policies.get(name, OVERWRITE)
    if name not in old_names or name == key:
        return new
    return F.when(F.col("h").isNotNull(), policy.combine(new, F.col(f"h.{name}"))).otherwise(new)


def merge_with_history(new: DataFrame, history: DataFrame, key: str, policies: dict[str, Policy], pos: str = "pos") -> DataFrame:
    """Every new row; where history has its key, the columns follow their policies.

    history carries `pos`, its order: the first row of a key counts. Null keys match null keys."""
    return _sides(new, history, key, "left", pos).select(*(_merged(c, key, policies, history.columns).alias(c) for c in new.columns))


def _folded(policy: Policy, name: str, pos: str) -> Column:
    """What the new rows of a key come to in one column, each merged over those before."""
    if policy.over is not None:
        return policy.over(F.col(name), F.col(pos))
    values = F.transform(F.sort_array(F.collect_list(F.struct(pos, name))), lambda r: r[name])
    return F.aggregate(F.slice(values, 2, F.size(values)), values[0], lambda so_far, new: policy.combine(new, so_far))


def upsert(new: DataFrame, history: DataFrame, key: str, policies: dict[str, Policy], pos: str = "pos") -> DataFrame:
    """All rows of history, the first of each key merged with the new rows of the key, then the new keys.

    New rows that share a key are merged in their order, each over what those before have made. `is_new`
    tells rows of new keys, so the order is that of (is_new, pos); pos must tell the rows of history
    apart. Null keys match null keys. Rows of history stay as wide as they are until the one join."""
    columns = [c for c in new.columns if c not in (key, pos)]
    cells = [_folded(policies.get(c, OVERWRITE), c, pos).alias(c) for c in columns]
    n = new.groupBy(key).agg(*cells, F.min(pos).cast("long").alias("_new_pos"))
    first = history.groupBy(F.col(key).alias("_key")).agg(F.min(pos).alias("_first"))
    n = n.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    h = history.withColumn("_here", F.lit(True))
    same = F.col(f"h.{key}").eqNullSafe(F.col(f"n.{key}")) & (F.col(f"h.{pos}") == F.col("n._first"))
    met = h.alias("h").join(n.alias("n"), same, "full")
    both = F.col("h._here").isNotNull() & F.col("n._new_pos").isNotNull()

    def cell(c: str) -> Column:
        if c not in history.columns:
            return F.col(f"n.{c}")
        merged = policies.get(c, OVERWRITE).combine(F.col(f"n.{c}"), F.col(f"h.{c}"))
        return F.when(both, merged).when(F.col("h._here").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(f"n.{c}"))

    is_new = F.col("h._here").isNull()
    return met.select(
        F.when(is_new, F.col(f"n.{key}")).otherwise(F.col(f"h.{key}")).alias(key),
        *(cell(c).alias(c) for c in columns),
        F.when(is_new, F.col("n._new_pos")).otherwise(F.col(f"h.{pos}").cast("long")).alias(pos),
        is_new.alias("is_new"),
    )
