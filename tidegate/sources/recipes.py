"""Saved cleaning recipes: one JSON row per step, large spelling tables beside it as Parquet."""
from __future__ import annotations

import json

from pyspark.sql import SparkSession


def write_recipe(spark: SparkSession, recipe: list[dict], path: str) -> None:
    rows = []
    for i, r in enumerate(recipe):
        params = dict(r["params"])
        if "table" in params:
            side = f"{path}-forms-{i}"
            params["table"].write.parquet(side)
            params["table"] = side
        rows.append((i, r["op"], r["column"], json.dumps(params), r["rows_removed"]))
    spark.createDataFrame(rows, "step int, op string, column string, params string, rows_removed bigint").coalesce(1).write.json(path)


def read_recipe(spark: SparkSession, path: str) -> list[dict]:
    out = []
    schema = "step int, op string, column string, params string, rows_removed bigint"
    for r in spark.read.schema(schema).json(path).orderBy("step").collect():      # one row per committed step
        params = json.loads(r["params"])
        if "table" in params:
            params["table"] = spark.read.parquet(params["table"])
        out.append({"op": r["op"], "column": r["column"], "params": params, "rows_removed": r["rows_removed"]})
    return out
