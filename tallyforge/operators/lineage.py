"""Where checkpoints go: plans that loop cut their lineage with checkpoint(), in the folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: spark.checkpoint.dir, or one set here where all run in one process."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    checkpoints(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def measured(df: DataFrame) -> DataFrame:
    """df as a side of a join that isn't planned by what df is estimated to hold.

    A checkpoint keeps the estimate of the plan that it was made from, and that goes by the bytes of compressed files, whatever was
    generated from them since; by it a table of any size would be sent through the driver to be broadcast.
    """
    return df.hint("merge")


def gathered(df: DataFrame) -> DataFrame:
    """df in no more tasks than a shuffle has: a union has those of all its parts."""
    return df.coalesce(_dealt(df.sparkSession))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores by its keys: few bytes on disk make few tasks, however much is then made of each row."""
    return df.repartition(_dealt(df.sparkSession), *keys)


def _dealt(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
