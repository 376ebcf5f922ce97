"""Cleaned-table sink with its manifest."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.operators.compare import cells_changed


def ops_text(ops: dict[str, str]) -> str:
    return ", ".join(f"{c}={o}" for c, o in ops.items()) or "(none)"


def write_cleaned(before: DataFrame, cleaned: DataFrame, ops: dict[str, str], row_id: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the cleaned rows and a one-row manifest beside them; returns the manifest."""
    writer = cleaned.write.option("header", True) if fmt == "csv" else cleaned.write
    writer.format(fmt).save(f"{path}/rows")
    spark = before.sparkSession
    out = spark.read.schema(cleaned.schema).parquet(f"{path}/rows") if fmt == "parquet" else cleaned
    manifest = cells_changed(before, out, row_id).select(
        F.lit(ops_text(ops)).alias("committed_ops"), F.lit(before.count()).alias("rows_in"), F.lit(out.count()).alias("rows_out"), "cells_changed")
    manifest.write.json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")
