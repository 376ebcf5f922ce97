"""Audit logs on disk: JSON, one row per iteration, partitioned by run."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.plans.gate import AUDIT_SCHEMA

LOG_SCHEMA = "run string, " + AUDIT_SCHEMA


def write_log(log: DataFrame, path: str) -> None:
    """Append the rows of one or many runs. Rows carry their run, so files may hold several runs."""
    log.write.mode("append").json(path)


def read_log(spark: SparkSession, paths: str | list[str], schema=LOG_SCHEMA) -> DataFrame:
    """One or many logs; path lists and globs are fine. The schema is given, never inferred."""
    return spark.read.schema(schema).json(paths)
