"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, written

#: Up to so many edges (16 bytes each) one task finds the components by itself; beyond, rounds of joins do.
LOCAL_EDGES = 500_000


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _local(batches):
    """Union-find over all edges of a small graph."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
    nodes = list(up)
    for i in range(0, len(nodes), 65536):
        some = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node reachable), for every node of an edge; one row each.

    Only minima by node are formed, so no node's neighbours meet in one task but for a join that can be split.
    """
    e = held(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _state(e)
    if before[0] <= LOCAL_EDGES:
        return e.repartition(1).mapInArrow(_local, "node long, root long")
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
