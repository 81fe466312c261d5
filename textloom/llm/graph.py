"""Connected components of an edge table; no edge list ever leaves the cluster.

Alternating large and small stars shrink the edges until nothing changes. As soon as no more than LOCAL edges are left, one
task joins them in a table of parents: a bounded number of rows, counted before. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.base import cut

#: Edges, 16 bytes each, that one task may join.
LOCAL = 500_000


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it knows, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _nearest(both).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours and itself to the smallest of them. Needs u > v."""
    least = _nearest(edges)
    inner = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def joined(edges: DataFrame) -> DataFrame:
    """node, root of at most LOCAL edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([top(x) for x in parent], pa.int64())], ["node", "root"])

    return cut(edges.coalesce(1).mapInArrow(run, "node long, root long"), "roots")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node with an edge other than a loop. edges: a, b of type long."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = cut(now, "edges")
    seen = _print(now)
    while seen[0] > LOCAL:
        now = cut(small_star(large_star(now)), "edges")
        after = _print(now)
        if after == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = after
    return joined(now)
