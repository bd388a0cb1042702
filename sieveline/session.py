"""Session defaults, checkpoint location and input balancing."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "sieveline") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster passes in its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites of column expressions are only worth their cost while debugging.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; only a single-machine session without one gets a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="sieveline-ckpt-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def balanced(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Spread a scan that yields fewer splits than cores (one small file, one row group).

    Regex work is CPU bound, so a single split would run on one core. A scan that already has enough splits -- any
    table of real size -- is returned untouched, without a shuffle. Keys must be unique row ids.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
