"""Connected components by alternating star contraction on DataFrames.

Edges never come to the driver: each round is two aggregations and two joins
on the node, so a hub is an aggregate (combined on the map side) and a join
of two written tables, whose hub adaptive execution can split.  Rounds grow
with the logarithm of the longest chain.  Each round is written to the shared
folder and the one before it removed.

A graph of at most ``local`` edges (16 bytes each, counted first) is done by
union-find in one task, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One large-star or small-star step over edges (u, v), u > v."""
    # directed: large looks from each end at all neighbours, small only at the smaller ones
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    least = materialize(least, name + "-least")
    got = both.join(least, "u")
    if large:
        out = got.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = got.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = materialize(out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    drop_table(least)
    return done


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.fromiter(map(root, nodes), np.int64, len(nodes)))], ["node", "root"])


def connected_components(edges: DataFrame, name: str = "components", local: int = 500_000) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the component's smallest node."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = state(e)
    if seen[0] <= local:
        return materialize(e.repartition(1).mapInArrow(_union_find, "node long, root long"), name)
    while True:
        middle = _star(e, True, name)
        after = _star(middle, False, name)
        drop_table(middle)
        drop_table(e)
        e, now = after, state(after)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
