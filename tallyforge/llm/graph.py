"""Connected components of an edge table: union-find for few edges, large-star and small-star steps on DataFrames for more."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones and itself) tied to the least of its neighbourhood.

    The least is found with map-side aggregation; the join that hands it out can be split where a node has very many edges.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one other that points nowhere."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n"))
    targets = edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1).cast("bigint"))
    return ends.unionByName(targets).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all edges of a task, by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (to := up.setdefault(x, x)) != x:
            up[x] = up[to]
            x = to
        return x

    for batch in batches:
        for u, v in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, most: int = 60, alone: int = 200_000) -> DataFrame:
    """(node, component) of every node of edges (u, v), two longs: component is the least node reachable.

    Up to `alone` edges (they are counted) are united in one task. More go through large-star and small-star steps, each
    written to the shared folder: every component ends as a star around its least node, and the number of steps grows
    with the logarithm of its size.
    """
    now = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", edges.count())
    if now.count() <= alone:
        return now.coalesce(1).mapInArrow(_united, "node long, component long")
    for _ in range(most):
        if _settled(now):
            break
        now = stored(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
