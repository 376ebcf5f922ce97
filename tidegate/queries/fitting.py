"""Fitted preprocessing and models that are saved, reloaded and applied."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators.folds import fixed_folds
from tidegate.plans import fitted as P
from tidegate.queries.base import ROW, folds_sql
from tidegate.queries.recommending import WIDE, in_train, wide_events
from tidegate.queries.registry import held, query
from tidegate.session import scratch_path

STEPS = [{"stage": "imputation", "method": "median+indicator", "columns": ["value"]}, {"stage": "scaling", "method": "robust", "columns": ["value"]},
         {"stage": "scaling", "method": "standard", "columns": ["user_id"]},
         {"stage": "imputation", "method": "constant_missing", "columns": ["event_type"]}, {"stage": "encoding", "method": "onehot", "columns": ["event_type"]},
         {"stage": "encoding", "method": "ordinal", "columns": ["hour"]}]

# the hour is a level of its own in some test rows
SPLIT = WIDE + ", w2 AS (SELECT wide.rid, wide.user_id, wide.value, wide.event_type, wide.target, strftime(e.ts, '%H') AS h FROM wide JOIN events e ON e.event_id = rid), " + folds_sql("w2", "w3", "1") + \
    ", w AS (SELECT *, CASE WHEN fold_0 = 0 AND rid % 9 = 0 THEN 'new' ELSE h END AS hour FROM w3)"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    from tidegate.sources.tables import table
    hours = table(spark, sf, "events").select(F.col("event_id").alias(ROW), F.date_format("ts", "HH").alias("h"))
    df = fixed_folds(wide_events(spark, sf).drop("props").join(hours, ROW), F.lit(1), ROW)
    return held(df.withColumn("hour", F.when((F.col("fold_0") == 0) & (F.col(ROW) % 9 == 0), "new").otherwise(F.col("h"))))


@query("WITH " + SPLIT + """, t AS (SELECT * FROM w WHERE fold_0 <> 0), m AS (SELECT median(value) AS med FROM t),
  q AS (SELECT quantile_cont(coalesce(value, med), 0.25) AS a, median(coalesce(value, med)) AS b, quantile_cont(coalesce(value, med), 0.75) AS c FROM t, m),
  u AS (SELECT avg(user_id) AS mu, stddev_pop(user_id) AS sd FROM t),
  k AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS code FROM (SELECT DISTINCT hour FROM t)),
  e AS (SELECT DISTINCT coalesce(event_type, '__missing__') AS lev FROM t)
  SELECT w.rid, name, round(x, 6) + 0.0 AS x FROM (
    SELECT w.rid, 'value' AS name, (coalesce(value, med) - b) / (c - a) AS x FROM w, m, q
    UNION ALL SELECT w.rid, 'value_missing', CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END FROM w
    UNION ALL SELECT w.rid, 'user_id', (user_id - mu) / sd FROM w, u
    UNION ALL SELECT w.rid, 'event_type=' || lev, CASE WHEN coalesce(event_type, '__missing__') = lev THEN 1.0 ELSE 0.0 END FROM w, e
    UNION ALL SELECT w.rid, 'hour_code', CAST(coalesce(code, -1) AS DOUBLE) FROM w LEFT JOIN k ON w.hour = k.hour) w""")
def stage2_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on training rows, saved with its model, reloaded, applied to all rows: every number by its name."""
    df = rows(spark, sf)
    path = scratch_path(spark, "fitted")
    P.fit_model(df, STEPS, "binary", "linear", (F.col("target") == "rare").cast("int"), ROW, in_train()).save(path)
    back = P.load_model(spark, path)
    names = F.array(*[F.lit(n) for n in P.names(back.chains)])
    each = F.explode(F.arrays_zip(names.alias("name"), P.features(back.chains).alias("x"))).alias("e")
    return df.select(ROW, each).select(ROW, F.col("e.name").alias("name"), (F.round("e.x", 6) + 0.0).alias("x"))


@query()
def stage2_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """A neural regressor fitted on training rows, saved, reloaded and scored on test rows, against their mean."""
    df = rows(spark, sf)
    steps = [s for s in STEPS if s["columns"] != ["value"]]
    path = scratch_path(spark, "fitted")
    P.fit_model(df, steps, "regression", "neural", F.log1p(F.abs("value")), ROW, in_train()).save(path)
    said = P.load_model(spark, path).apply(df.where(~in_train()), ROW)
    y = df.where(~in_train() & F.col("value").isNotNull()).select(ROW, F.log1p(F.abs("value")).alias("y"))
    return y.join(said, ROW).agg(F.count("*").alias("n_test"), F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("squared_error"),
                                 F.var_pop("y").alias("of_the_mean"))
