"""Value histograms: the shared basis of the detectors and of every order statistic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.StringType)]


def value_histogram(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    """(column, value, n) of the non-null values of many columns: one unpivot and one aggregation.

    Counts are combined before the shuffle, so one value that fills a third of a column moves as
    one row per task.
    """
    return (
        df.select([F.col(c).cast(as_type).alias(c) for c in columns])
        .unpivot([], columns, "column", "value")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def in_models(models: list[Column | None]) -> Column:
    """Array of the model indices whose training set holds the row."""
    return F.array_compact(F.array(*[
        F.lit(i) if m is None else F.when(m, F.lit(i)) for i, m in enumerate(models)]))


def training_histogram(df: DataFrame, value: Column, models: list[Column | None]) -> DataFrame:
    """(column, value, n) where "column" is the model index: the histogram of every training set.

    A row counts in all models it trains, and is combined per (model, value) before the shuffle,
    so fifteen training sets cost one pass. The shape is that of ``value_histogram``, so detectors
    and fits share their rules.
    """
    return (df.select(value.alias("value"), F.explode(in_models(models)).alias("column"))
            .where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n")))
