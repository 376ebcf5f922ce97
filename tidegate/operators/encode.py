"""In-fold encoding as tables: one-hot with NULL level, imputation, scaling, and the leak guard."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.quantiles import Ask, exact_quantiles
from tidegate.operators.histogram import in_models

NULL_LEVEL = "<NA>"
RELATIVE = 1e-9           # sums may be added in another order, nothing more


def onehot_null(train: DataFrame, test: DataFrame, column: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """One sparse vector column; NULL is a level of its own and levels unseen in training are all zero
    in the level slots (the indexer's extra slot takes them, where no training row ever is)."""
    filled = lambda d: d.withColumn(f"{column}_level", F.coalesce(F.col(column), F.lit(NULL_LEVEL)))
    stages = [StringIndexer(inputCol=f"{column}_level", outputCol=f"{column}_code", handleInvalid="keep",
                            stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCol=f"{column}_code", outputCol=f"{column}_hot", dropLast=False, handleInvalid="keep")]
    model = Pipeline(stages=stages).fit(filled(train))
    return model.transform(filled(train)), model.transform(filled(test)), list(model.stages[0].labels)


def fold_medians(df: DataFrame, column: str, models: list[Column]) -> DataFrame:
    """(model, median): training medians, 0 for a column without training values."""
    q = exact_quantiles(df, [Ask(str(i), F.col(column), (0.5,), m) for i, m in enumerate(models)])
    rows = [(i, float(q[str(i)][0]) if q[str(i)] else 0.0) for i in range(len(models))]
    return df.sparkSession.createDataFrame(rows, "model int, median double")


def fold_moments(df: DataFrame, columns: list[str], models: list[Column]) -> DataFrame:
    """(model, column, n, mean, std): training rows only, population standard deviation."""
    return (df.select(F.explode(in_models(models)).alias("model"), *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["model"], columns, "column", "v").groupBy("model", "column")
            .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")))


def by_model(df: DataFrame, models: list[Column]) -> DataFrame:
    """Every row once per model, with its side: the long form of fold-local application."""
    sides = F.array(*[F.struct(F.lit(i).alias("model"), m.alias("in_train")) for i, m in enumerate(models)])
    return df.select("*", F.explode(sides).alias("_s")).select("*", "_s.model", "_s.in_train").drop("_s")


def scaled(long: DataFrame, moments: DataFrame, column: str) -> DataFrame:
    """Add <column>_scaled from the model's training moments: one row per model, broadcast, so the long form is never shuffled."""
    m = moments.where(F.col("column") == column).select("model", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return long.join(F.broadcast(m), "model").withColumn(f"{column}_scaled", (F.col(column) - F.col("_m")) / scale).drop("_m", "_s")


def leak_guard(long: DataFrame, moments: DataFrame, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(model, column, leaks): are the fitted means those of the model's training rows, recomputed here?"""
    again = (long.where("in_train").select("model", *[F.col(c).cast("double").alias(c) for c in columns])
             .unpivot(["model"], columns, "column", "v").groupBy("model", "column").agg(F.avg("v").alias("expected")))
    off = F.abs(F.col("mean") - F.col("expected")) > tolerance + RELATIVE * F.abs("expected")
    return moments.join(again, ["model", "column"]).select("model", "column", off.alias("leaks"))
