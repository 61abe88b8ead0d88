"""SimHash near-duplicates: fingerprints, exact pairs by sharded vantage-point trees, components.

Fingerprints of equal value are one node. The nodes are dealt to the leaves of a router tree
(see vp_tree) whose size follows their number, up to MOST_LEAVES, as the router is fitted on a
sample in the driver. Beyond 8 million distinct fingerprints the shards grow instead: with
10^10 of them a shard holds 2.4 million, 22 bytes each. A node also visits, as a query, half of the leaves that its ball of LINK_BITS may overlap, so each close pair meets in
exactly one shard. A shard grows its own tree, links what it finds in a union-find and
returns a spanning forest, at most one row a node, so a dense group does not emit its pairs.

Null and empty texts, and texts of white space, have the fingerprint 0, which links like any
other. Repeated rows stay. A null doc_id counts for no component_id; if all of a component
are null, its component_id is null. No documents give no rows; a very long text is hashed
in parts, but its words are held at once. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import connected_components
from .near_copies import surplus
from .vp_tree import Forest, Router, close_pairs

SHINGLE_WORDS, LINK_BITS, SEED = 3, 2, 42
#: Nodes that a leaf is meant for, the most leaves of a router, and sampled nodes for each leaf.
LEAF_NODES, MOST_LEAVES, SAMPLE_A_LEAF = 2048, 4096, 32
_SHINGLES_AT_ONCE = 1 << 16


def simhash(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one UTF-8 text; bytes.lower and bytes.split know ASCII only, as wanted."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, _SHINGLES_AT_ONCE):
        part = tokens[lo : lo + _SHINGLES_AT_ONCE + words - 1]
        grams = zip(*(part[k:] for k in range(words))) if len(tokens) >= words else [part]
        hashes = np.array([digest(join(g), seed) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text, as a signed long. Other columns do not leave the JVM."""

    def hashed(texts: pa.Array) -> pa.Array:
        raw = pc.fill_null(texts, "").cast(pa.large_binary())
        return pa.array(np.fromiter((simhash(t.as_py()) for t in raw), np.uint64, len(raw)).view(np.int64))

    return F.arrow_udf(hashed, "long")(text.cast("string"))


def close_links(nodes: DataFrame, reach: int = LINK_BITS, leaf_nodes: int = LEAF_NODES) -> DataFrame:
    """Links a, b between distinct fingerprints `fp` that connect what lies within reach."""
    total = nodes.count()
    leaves = min(MOST_LEAVES, max(1, total // leaf_nodes))
    sample = nodes.orderBy(F.xxhash64("fp")).limit(leaves * SAMPLE_A_LEAF) if leaves > 1 else nodes.limit(0)
    router = Router(np.array([r.fp for r in sample.collect()], dtype=np.int64).view(np.uint64), leaves)

    def routed(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            points = fps.view(np.uint64)
            own_row, own_leaf = router.visits(points, 0)
            own = np.empty(len(points), np.int64)
            own[own_row] = own_leaf
            row, leaf = router.visits(points, reach)
            # Of two leaves one visits the other, in turns, so that all get about as many visits.
            goes = (leaf == own[row]) | ((leaf > own[row]) == ((leaf + own[row]) % 2 == 0))
            row, leaf = row[goes], leaf[goes]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[row]), pa.array(leaf == own[row])], names=["leaf", "fp", "own"])

    def linked(shard: pd.DataFrame) -> pd.DataFrame:
        fps, own = shard["fp"].to_numpy(np.int64), shard["own"].to_numpy(bool)
        order = np.argsort(~own, kind="stable")  # the shard's own nodes first
        fps, points, n = fps[order], fps[order].view(np.uint64), int(own.sum())
        forest = Forest(len(fps))
        for d, q in close_pairs(points[:n], points, reach):
            forest.link(d, q)
        root = forest.roots()
        tied = root != np.arange(len(root))
        return pd.DataFrame({"a": fps[root[tied]], "b": fps[tied]})

    return nodes.select("fp").mapInArrow(routed, "leaf long, fp long, own boolean").groupBy("leaf").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, reach: int = LINK_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    prints = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fp")))
    return _labelled(prints, reach).select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _labelled(prints: DataFrame, reach: int) -> DataFrame:
    """prints with root, the component's smallest fingerprint, and component_id, its smallest doc_id.

    What a join meets is stashed first, so both of its sides are shuffled for it alone and
    adaptive execution can split a hot fingerprint or root.
    """
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(close_links(nodes, reach))
    tied = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    ids = stash(tied.groupBy("root").agg(F.min("first_id").alias("component_id")))
    grouped = roots.join(ids, "root").select(F.col("node").alias("fp"), "root", "component_id")
    named = nodes.join(grouped, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return prints.join(stash(named), "fp")


def keep_first(docs: DataFrame, reach: int = LINK_BITS, similarity: float | None = None) -> DataFrame:
    """The rows of docs with one document of each component: that of the smallest doc_id.

    Of rows that share this doc_id, one stays. A component without any doc_id keeps one row.
    With a similarity, what stays is also rid of near copies on five-word shingles (see near_copies).
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    whole = stash(docs.select(doc, fingerprint(F.col("text")).alias("fp"), F.monotonically_increasing_id().alias("row")))
    labelled = _labelled(whole.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "fp", "row"), reach)
    first = stash(labelled.where("doc_id <=> component_id").groupBy("root").agg(F.min("row").alias("row")).select("row"))
    if similarity is not None:
        held = whole.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
        first = stash(first.join(surplus(held, similarity, among=first), "row", "left_anti"))
    return whole.join(first.hint("shuffle_hash"), "row", "left_semi").select("doc.*")
