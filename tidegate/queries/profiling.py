"""Profiles and validation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators import profile as P
from tidegate.operators.histogram import value_histogram
from tidegate.queries.base import DIRTY_ORDERS, ROW, dirty_orders
from tidegate.queries.registry import query
from tidegate.sources.tables import TaskSpec, table

LINE_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
              "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
              "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
STAR = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
        "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal*", "c_mktsegment"),
        "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal*"),
        "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice*"),
        "events": ("event_id", "ts", "user_id", "event_type", "value*", "props"),
        "documents": ("doc_id", "text", "lang", "source", "n_chars")}       # * marks fractional columns


@query(" UNION ALL ".join(
    f"SELECT count(*) AS rows, CAST(11 AS BIGINT) AS n_columns, '{c}' AS \"column\", '{t}' AS dtype, "
    f"count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c, t in LINE_TYPES.items()))
def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_table(table(spark, sf, "lineitem"))


def _iqr_sql(c: str, dtype: str, numeric: bool) -> str:
    out = "CAST(NULL AS BIGINT)"
    if numeric:
        q = f"(SELECT quantile_cont({c}, {{}}) FROM dord)"
        q1, q3 = q.format(0.25), q.format(0.75)
        out = (f"CASE WHEN {q1} = {q3} THEN 0 ELSE count(*) FILTER ({c} < {q1} - 1.5 * ({q3} - {q1}) "
               f"OR {c} > {q3} + 1.5 * ({q3} - {q1})) END")
    return (f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, "
            f"round_even(CAST(100 * (count(*) - count({c})) AS DOUBLE) / count(*), 2) AS null_pct, {out} AS outlier_count FROM dord")


@query("WITH " + DIRTY_ORDERS + " " + " UNION ALL ".join([
    _iqr_sql("o_custkey", "bigint", True), _iqr_sql("o_totalprice", "double", True), _iqr_sql("o_orderpriority", "string", False)]))
def profile_null_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_null_iqr(dirty_orders(spark, sf)[0], (ROW, "o_orderstatus"))


def _skew_sql(c: str, numeric: bool) -> str:
    skew = f"coalesce(round(skewness({c}), 6), 0)" if numeric else "CAST(0 AS DOUBLE)"
    return (f"SELECT '{c}' AS \"column\", '{'numeric' if numeric else 'categorical'}' AS kind, "
            f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS missing_frac, {skew} AS skew, "
            f"count(DISTINCT {c}) AS n_unique FROM events")


@query(" UNION ALL ".join([_skew_sql("user_id", True), _skew_sql("value", True), _skew_sql("event_type", False), _skew_sql("props", False)]))
def profile_skew(spark: SparkSession, sf: str) -> DataFrame:
    p = P.profile_columns(table(spark, sf, "events"), ["user_id", "value", "event_type", "props"])
    return p.withColumn("missing_frac", F.round("missing_frac", 6)).withColumn("skew", F.round("skew", 6))


@query("""WITH v AS (SELECT DISTINCT trim(p_name) AS value FROM part WHERE trim(p_name) <> '')
  SELECT value, (SELECT count(*) FROM v) > 60 AS capped FROM v ORDER BY value LIMIT 61""")
def distinct_capped(spark: SparkSession, sf: str) -> DataFrame:
    return P.distinct_capped(table(spark, sf, "part"), "p_name")


def _id_name(c: str) -> bool:
    import re
    from tidegate.constants import ID_NAME_PATTERN
    return re.search(ID_NAME_PATTERN.removeprefix("(?i)"), c, re.I) is not None


def _id_sql(t: str, col: str) -> str:
    c, frac = col.rstrip("*"), col.endswith("*")
    rule = "false" if frac else f"(count(*) > 50 AND count(DISTINCT {c}) >= CAST(0.98 AS DOUBLE) * count({c}))"
    return (f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count(*) AS rows FROM {t} "
            f"HAVING {rule} OR {str(_id_name(c)).lower()}")


@query(" UNION ALL ".join(_id_sql(t, c) for t, cols in STAR.items() for c in cols))
def detect_id_like(spark: SparkSession, sf: str) -> DataFrame:
    parts = [P.id_like_columns(table(spark, sf, t)).withColumn("table", F.lit(t)) for t in STAR]
    return reduce(DataFrame.unionByName, parts)


@query("WITH " + DIRTY_ORDERS + """, c AS (SELECT count(DISTINCT trim(o_orderstatus)) AS k, count(*) - count(o_orderstatus) AS m FROM dord)
  SELECT 'error' AS level, 'target_binary' AS "check", 'o_orderstatus' AS "column",
    'binary target must have exactly 2 classes, found ' || k AS message, 'binary' AS task FROM c WHERE k <> 2
  UNION ALL SELECT 'warning', 'target_missing', 'o_orderstatus', m || ' rows have a missing target and will be dropped', t
    FROM c, (VALUES ('binary'), ('multiclass'), ('regression')) v(t) WHERE m > 0
  UNION ALL SELECT 'warning', 'target_multiclass', 'o_orderstatus', 'multiclass target has ' || k || ' classes', 'multiclass' FROM c WHERE k < 3
  UNION ALL SELECT 'error', 'target_numeric', 'o_orderstatus', 'regression needs a numeric target', 'regression' FROM c
  UNION ALL SELECT 'warning', 'gate', 'o_orderstatus', 'no gate for ' || t || ': detection only', t
    FROM (VALUES ('multiclass'), ('regression')) v(t)""")
def validate_target(spark: SparkSession, sf: str) -> DataFrame:
    df = dirty_orders(spark, sf)[0]
    parts = [P.validate_target(df, TaskSpec("o_orderstatus", t)).withColumn("task", F.lit(t))
             for t in ("binary", "multiclass", "regression")]
    return reduce(DataFrame.unionByName, parts)


SPARSE = "sparse AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 4000 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"


def _issues_sql(c: str, text: bool, frac: bool) -> str:
    out = [f"SELECT 'warning' AS level, 'missingness' AS \"check\", '{c}' AS \"column\", CAST(CAST(round_even(100 * "
           f"(CAST(count(*) - count({c}) AS DOUBLE) / count(*)), 0) AS BIGINT) AS VARCHAR) || '% missing' AS message FROM sparse "
           f"HAVING CAST(count(*) - count({c}) AS DOUBLE) / count(*) > 0.4"]
    rule = "false" if frac else f"(count(*) > 50 AND count(DISTINCT {c}) >= CAST(0.98 AS DOUBLE) * count({c}))"
    out.append(f"SELECT 'warning', 'id_like', '{c}', 'looks like an id (' || count(DISTINCT {c}) || ' distinct of ' || count(*) || ')' "
               f"FROM sparse HAVING {rule} OR {str(_id_name(c)).lower()}")
    if text:
        out.append(f"SELECT 'error', 'levels', '{c}', count(DISTINCT {c}) || ' distinct values, more than 300' FROM sparse "
                   f"HAVING count(DISTINCT {c}) > 300")
    return " UNION ALL ".join(out)


@query("WITH " + SPARSE + " " + " UNION ALL ".join([
    _issues_sql("c_custkey", False, False), _issues_sql("c_name", True, False), _issues_sql("c_nationkey", False, False),
    _issues_sql("c_acctbal", False, True),
    "SELECT 'error', 'target_binary', 'c_mktsegment', 'binary target must have exactly 2 classes, found ' || "
    "count(DISTINCT c_mktsegment) FROM sparse HAVING count(DISTINCT c_mktsegment) <> 2",
    "SELECT 'error', 'target_exists', 'nope', 'target column is not in the table'",
    "SELECT 'error', 'column_exists', 'gone', 'id/drop column is not in the table'",
    "SELECT 'error', 'target_excluded', 'c_mktsegment', 'target cannot be an id/drop column'"]))
def validate_issues(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse customer table under a runnable task and under two broken ones."""
    df = table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 4000, F.col("c_acctbal")))
    specs = [TaskSpec("c_mktsegment"), TaskSpec("nope"), TaskSpec("c_mktsegment", id_columns=("gone", "c_mktsegment"))]
    return reduce(DataFrame.unionByName, [P.validate(df, s) for s in specs])


@query("""WITH c AS (SELECT trim(CAST(quality AS VARCHAR)) AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1),
  t AS (SELECT trim(CAST(toxic AS VARCHAR)) AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1)
  SELECT 'quality' AS target, (SELECT label FROM c ORDER BY n, label LIMIT 1) AS positive, '1' AS explicit
  UNION ALL SELECT 'toxic', (SELECT label FROM t ORDER BY n, label LIMIT 1), '1'""")
def positive_label(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "labels")
    rows = [(t, P.positive_label(df, TaskSpec(t)), P.positive_label(df, TaskSpec(t, positive_label="1"))) for t in ("quality", "toxic")]
    return spark.createDataFrame(rows, "target string, positive string, explicit string")


@query(" UNION ALL ".join(
    f"""SELECT '{t}' AS target, count(*) AS n_classes, round(CAST(min(n) AS DOUBLE) / max(n), 6) AS ratio,
    count(*) >= 2 AND CAST(min(n) AS DOUBLE) / max(n) < 0.25 AS imbalanced
    FROM (SELECT {t}, count(*) AS n FROM {src} GROUP BY 1)""" for t, src in
    (("quality", "labels"), ("toxic", "labels"), ("o_orderstatus", "orders"), ("c_mktsegment", "customer"))))
def class_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    pairs = (("quality", "labels"), ("toxic", "labels"), ("o_orderstatus", "orders"), ("c_mktsegment", "customer"))
    parts = [P.class_imbalance(table(spark, sf, src), t).withColumn("target", F.lit(t)) for t, src in pairs]
    return reduce(DataFrame.unionByName, parts).withColumn("ratio", F.round("ratio", 6))


HIST_COLS = ("l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem "
                          f"WHERE {c} IS NOT NULL GROUP BY 2" for c in HIST_COLS), name="value_histogram")
def value_histogram_query(spark: SparkSession, sf: str) -> DataFrame:
    return value_histogram(table(spark, sf, "lineitem"), list(HIST_COLS), "string")
