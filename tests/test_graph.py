"""Closures walk every edge, however long the chain and whatever the ids."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import graph
from tallyforge.plans import inventory


@pytest.fixture
def shared(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


def test_closure_of_long_chain(spark, shared):
    edges = spark.range(0, 70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).localCheckpoint()
    found = graph.closure(edges, spark.range(0, 1).select(F.col("id").alias("node")))
    assert {r.node: r.level for r in found.collect()} == {k: k for k in range(71)}


def test_closure_bfs_takes_all_parts(spark, shared, tmp_path):
    rows = spark.createDataFrame([(7, 501), (501, 9000), (9000, 3), (4, 5)], "l_partkey long, l_suppkey long")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.node for r in inventory.queries()["closure_bfs"](spark, str(tmp_path)).collect()} == {7, 501, 9000, 3}
