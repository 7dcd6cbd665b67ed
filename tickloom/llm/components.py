"""Connected components of an edge table: in one task where its counted size allows it, and else by stars.

Both ways give the same labels.  A table of up to FEW_EDGES edges (16 bytes each) is joined up by one task; a larger
one by alternating large-star and small-star steps, in which no task holds more than its share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


FEW_EDGES = 1_000_000


def _joined(batches):
    """(node, label) of all edges of the batches, by repeated minima over the edges and halving of paths."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(names))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low != high
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (again := root[root] != root).any():
            root[again] = root[root[again]]
    for i in range(0, len(names), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 16)]), pa.array(names[root[i : i + (1 << 16)]])], ["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, label) for every node of an edge; the label is the smallest node of its component.

    Each step is a grouped minimum, combined before the shuffle, and a join back, whose large keys Spark can
    split; no neighbour list is gathered.  The rounds grow with the logarithm of the number of nodes.  Every round
    is written to the shared folder, so a lost executor costs no more than one round.
    """
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    if plain.limit(few + 1).count() <= few:
        return written(plain.coalesce(1).mapInArrow(_joined, "node bigint, label bigint"))
    e = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _state(e)
    for _ in range(most_rounds):
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = written(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(e)
        discard(large)
        e, after = small, _state(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(e: DataFrame) -> tuple:
    """Number and order-free hash of the edges; equal before and after a round only at the fixed point."""
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)
