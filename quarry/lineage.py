"""Cutting of lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> None:
    """Uses the checkpoint folder the cluster names. Where none is named, a session on one machine gets a temporary one, removed
    at the end of the process; a cluster is refused, since its executors share no folder that could be guessed."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quarry-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder, so that later reads neither recompute it nor depend on an executor. With
    spark.cleaner.referenceTracking.cleanCheckpoints the session removes it once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    shared_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the checkpoint folder: smaller than a checkpoint, and read by column."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files and checkpoints that nothing refers to any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """df over all cores where it is estimated at under `least` bytes a core: so small an input often lies in one file of one
    row group, which one task would read. Larger inputs have splits enough and stay as they are."""
    n = cores(df.sparkSession)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n) if n > 1 and size < n * least else df


def sent_if_small(df: DataFrame, most: int) -> DataFrame:
    """df, written to the checkpoint folder, with a broadcast hint if it has at most `most` rows; a larger one is joined by a
    shuffle. The rows are counted, not estimated, so that a growing side never reaches the driver."""
    from pyspark.sql import functions as F

    made = cut(df)
    return F.broadcast(made) if made.limit(most + 1).count() <= most else made
