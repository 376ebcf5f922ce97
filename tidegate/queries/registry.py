"""Where query modules register a Spark query and, when SQL can express it, its SQL twin."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_HELD: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Keep a table that several jobs of one query read; it is released when the next query starts."""
    _HELD.append(df.persist())
    return df


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            while _HELD:
                _HELD.pop().unpersist()
            return fn(spark, sf_dir)
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn
    return add
