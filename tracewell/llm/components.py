"""Connected components of a graph given by its edges, as Spark jobs: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (u, v) but the roots: the root is the component's smallest node.

    Each round links larger neighbours, then smaller ones, to the smallest neighbour known; the number of rounds grows
    with the logarithm of the longest path. A round's edges are written, so no lineage grows. A hub's edges are split by
    adaptive execution, as its smallest neighbour comes from another exchange."""
    start = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with scratch(edges.sparkSession):
        edges = written(start, "edges")
        before = _state(edges)
        for _ in range(rounds):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(spread(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u != v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(spread(least, "u"), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            edges = written(small.select("e.u", F.col("e.m").alias("v")).where("u != v").distinct(), "edges")
            after = _state(edges)
            if after == before:
                return written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "components", keep=True)
            before = after
    raise RuntimeError(f"components are not stable after {rounds} rounds")
