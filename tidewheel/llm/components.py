"""Connected components by alternating stars, in DataFrames with tables in the shared folder between rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

MOST_ROUNDS = 60
#: Edges that one task may hold (two arrays of 16 MB): so many, or fewer, are joined in one pass instead of further rounds.
HELD_EDGES = 2_000_000


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge, to a root."""
    forked = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("u")
    deep = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return forked.unionByName(deep).isEmpty()


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the least node of the component of each: minima hooked along edges, then pointers doubled."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _at_once(edges: DataFrame) -> DataFrame:
    """Components of edges of a checked, bounded number, in one task."""

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        empty = np.empty(0, np.int64)
        node, root = least_of(np.concatenate([empty, *[p[0] for p in parts]]), np.concatenate([empty, *[p[1] for p in parts]]))
        for k in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 100_000]), pa.array(root[k : k + 100_000])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, held_edges: int = HELD_EDGES) -> DataFrame:
    """(node, root) for each node of the links (a, b), long and not null; root: the smallest node of its component.

    Rounds in which every node points to the least one it knows leave at most an edge per node, until one task can hold
    the rest or nothing changes.  Hot nodes are safe: minima are pre-aggregated and the joins can be split.  No links, no rows.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        if edges.count() <= held_edges:
            found = stash(_at_once(edges))
            discard(edges)
            return found
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stash(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        discard(edges)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
