"""Connected components of a graph of longs by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a, b); root is the smallest node of its component.

    Each round points every node at its smallest neighbour, if that is smaller, follows the
    pointers to their ends, doubling the reach, and replaces the links by those of the ends. A hub costs no single task: minima are combined before the shuffle,
    and joins on a hub's key are plain joins that adaptive execution splits.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stash(links.where("a < b").distinct())
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        to = stash(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("to")))
        to = _collapsed(to)
        labels = to.withColumnRenamed("to", "root") if labels is None else _followed(labels, "root", to)
        links = _followed(_followed(links, "a", to), "b", to)
        links = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        labels = stash(labels)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _collapsed(to: DataFrame) -> DataFrame:
    """Every node pointed at the end of its chain of pointers."""
    while True:
        nxt = to.select(F.col("node").alias("to"), F.col("to").alias("far"))
        to = stash(to.join(nxt, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        if to.where("moved").isEmpty():
            return to.select("node", "to")
        to = to.select("node", "to")


def _followed(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """The column's nodes replaced by those that they point at; a node that is in no link any more stays."""
    step = to.select(F.col("node").alias(column), F.col("to").alias("_to"))
    return df.join(step, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
