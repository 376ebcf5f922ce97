"""Options from findings, and in-fold encoding."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate import constants as K
from tidegate.operators import encode as E
from tidegate.operators.detect import detect
from tidegate.operators.folds import fixed_folds, training_sets
from tidegate.plans import gate
from tidegate.queries.base import DIRTY_LINE, DIRTY_ORDERS, ROW, dirty_line, dirty_orders, folds_sql
from tidegate.queries.detection import LINE_CTES, LINE_FINDINGS
from tidegate.queries.registry import held, query
from tidegate.queries.repairing import LONG_FOLDS, _models_sql

PRIORITY = "CASE defect " + " ".join(f"WHEN '{d}' THEN {p}" for d, p in K.DEFECT_PRIORITY.items()) + " ELSE 9 END"
OPTIONS = f""", findings AS ({LINE_FINDINGS}),
  ex AS (SELECT defect, "column", n_rows, evidence, unnest(string_split(ops, ',')) AS operation, generate_subscripts(string_split(ops, ','), 1) AS pos,
    {PRIORITY} AS pr FROM findings WHERE ops <> ''),
  fi AS (SELECT * FROM ex WHERE NOT ("column" = 'l_discount' AND operation = 'drop_rows')
    QUALIFY row_number() OVER (PARTITION BY "column", operation ORDER BY pr, n_rows DESC, "column", defect, pos) = 1),
  opt AS (SELECT row_number() OVER (ORDER BY pr, n_rows DESC, "column", defect, pos) AS rank, "column", operation, defect, n_rows, evidence FROM fi)"""


def _options(spark: SparkSession, sf: str) -> DataFrame:
    rejected = spark.createDataFrame([("l_discount", "drop_rows")], "column string, operation string")
    return gate.remaining_options(detect(dirty_line(spark, sf)[0], "label", ROW), rejected)


@query("WITH " + DIRTY_LINE + ", " + LINE_CTES + OPTIONS + ' SELECT rank, "column", operation, defect, n_rows FROM opt')
def remaining_options(spark: SparkSession, sf: str) -> DataFrame:
    return _options(spark, sf).select(F.col("rank").cast("bigint").alias("rank"), "column", "operation", "defect", "n_rows")


@query("WITH " + DIRTY_LINE + ", " + LINE_CTES + OPTIONS + """ SELECT "column", operation,
  '[offline rule] ' || defect || ' in ' || "column" || ': ' || evidence || '.' AS reason FROM opt ORDER BY rank LIMIT 1""")
def plan_offline(spark: SparkSession, sf: str) -> DataFrame:
    return gate.plan(_options(spark, sf))


@query("WITH " + DIRTY_LINE + ", " + LINE_CTES + OPTIONS + """ SELECT rank, "column", operation FROM opt
  QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY rank) = 1""")
def blind_ops(spark: SparkSession, sf: str) -> DataFrame:
    return gate.blind_ops(_options(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


LEVELS = "SELECT DISTINCT coalesce(o_orderstatus, '<NA>') AS level FROM f WHERE fold_0 <> 0"


@query("WITH " + DIRTY_ORDERS + ", " + folds_sql("dord", "f", "1") + f""", lv AS ({LEVELS})
  SELECT fold_0 = 0 AS is_test, level, CAST(sum(CAST(coalesce(o_orderstatus, '<NA>') = level AS INTEGER)) AS BIGINT) AS ones, count(*) AS n_rows
  FROM f, lv GROUP BY ALL""")
def onehot_null(spark: SparkSession, sf: str) -> DataFrame:
    """Ones per level and side of the encoded matrix."""
    df = held(fixed_folds(dirty_orders(spark, sf)[0], F.lit(1), ROW))
    train, test, labels = E.onehot_null(df.where("fold_0 <> 0"), df.where("fold_0 = 0"), "o_orderstatus")
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    hot = vector_to_array("o_orderstatus_hot")
    slots = F.array(*[F.struct(F.lit(v).alias("level"), F.get(hot, F.lit(i)).alias("one")) for i, v in enumerate(labels)])
    return both.select("is_test", F.explode(slots).alias("s")).groupBy("is_test", F.col("s.level").alias("level")).agg(
        F.sum("s.one").cast("bigint").alias("ones"), F.count("*").alias("n_rows"))


FOLDED = DIRTY_LINE + ", " + folds_sql("dirty", "folded", "label") + ", " + _models_sql() + ", " + LONG_FOLDS


@query("WITH " + FOLDED + """, s AS (SELECT r, f, median(l_discount) FILTER (NOT is_test) AS med FROM long GROUP BY r, f)
  SELECT CAST(r * 5 + f AS INTEGER) AS model, is_test, round(med, 6) AS median, round(avg(coalesce(l_discount, med)), 8) AS mean_after,
  count(*) FILTER (l_discount IS NULL) AS filled FROM long JOIN s USING (r, f) GROUP BY ALL""")
def impute_in_fold(spark: SparkSession, sf: str) -> DataFrame:
    df = held(fixed_folds(dirty_line(spark, sf)[0], F.col("label"), ROW))
    medians = F.broadcast(E.fold_medians(df, "l_discount", training_sets()))          # one row per model
    long = E.by_model(df, training_sets()).join(medians, "model")
    return long.groupBy("model", (~F.col("in_train")).alias("is_test"), F.round("median", 6).alias("median")).agg(
        F.round(F.avg(F.coalesce("l_discount", "median")), 8).alias("mean_after"), F.count_if(F.col("l_discount").isNull()).alias("filled"))


@query("WITH " + FOLDED + """, s AS (SELECT r, f, avg(l_tax) FILTER (NOT is_test) AS mu, stddev_pop(l_tax) FILTER (NOT is_test) AS sd FROM long GROUP BY r, f)
  SELECT CAST(r * 5 + f AS INTEGER) AS model, is_test, round(avg((l_tax - mu) / sd), 6) + 0.0 AS mean_scaled,
  round(stddev_pop((l_tax - mu) / sd), 6) AS std_scaled FROM long JOIN s USING (r, f) GROUP BY ALL""")
def scale_in_fold(spark: SparkSession, sf: str) -> DataFrame:
    df = held(fixed_folds(dirty_line(spark, sf)[0], F.col("label"), ROW))
    long = E.scaled(E.by_model(df, training_sets()), E.fold_moments(df, ["l_tax"], training_sets()), "l_tax")
    return long.groupBy("model", (~F.col("in_train")).alias("is_test")).agg(
        (F.round(F.avg("l_tax_scaled"), 6) + F.lit(0.0)).alias("mean_scaled"), F.round(F.stddev_pop("l_tax_scaled"), 6).alias("std_scaled"))


@query("""WITH m AS (SELECT unnest(range(15)) AS model), k AS (SELECT unnest(['fold', 'all']) AS fitted_on),
  c AS (SELECT unnest(['l_quantity', 'l_tax']) AS "column") SELECT CAST(model AS INTEGER) AS model, "column", fitted_on, fitted_on = 'all' AS leaks FROM m, k, c""")
def leak_guard(spark: SparkSession, sf: str) -> DataFrame:
    """The guard passes on fold-fitted means and fires on means fitted on all rows."""
    df = held(fixed_folds(dirty_line(spark, sf)[0], F.col("label"), ROW))
    cols, models = ["l_quantity", "l_tax"], training_sets()
    long = E.by_model(df, models)
    good = E.leak_guard(long, E.fold_moments(df, cols, models), cols).withColumn("fitted_on", F.lit("fold"))
    bad = E.leak_guard(long, E.fold_moments(df, cols, [F.lit(True)] * len(models)), cols).withColumn("fitted_on", F.lit("all"))
    return good.unionByName(bad)
