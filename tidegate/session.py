"""Session helpers: the shared scratch folder, and how many rows one sorted group may hold."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidegate", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session.

    Only a local master may fall back to a temporary folder, because there the driver is the
    only machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidegate-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so a retry cannot read a half-written one."""
    return os.path.join(shared_dir(spark), "tidegate", f"{name}-{uuid.uuid4().hex}")


FEW_ROWS = 250_000         # rows of numbers that are written as one file per core at most


def few_files(df: DataFrame, most: int | None) -> DataFrame:
    """``df``, of at most ``most`` rows (None: unknown), to be written as one file per core where these are few, not as a file
    for each shuffle partition."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if most is not None and most <= FEW_ROWS else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared folder and reading it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
