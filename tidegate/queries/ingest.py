"""Sources and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.queries.base import DIRTY_ORDERS, ROW, dirty_orders, order_rows
from tidegate.queries.registry import query
from tidegate.session import scratch_path
from tidegate.sources.tables import (TaskSpec, canonical_text, concat_files, feature_target, load_dataset, normalise,
                                     read_csv, table)

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write a CSV whose header has blanks around the names, read it back."""
    path = scratch_path(spark, "csv")
    df = table(spark, sf, "customer")
    df.toDF(*[f" {c} " for c in df.columns]).write.option("header", True).csv(path)
    return read_csv(spark, path, CUSTOMER)


MESSY = {0: "' ' || {c} || '  '", 1: "'?'", 2: "' ? '", 3: "''", 4: "'   '", 5: "NULL"}


def _messy_segments(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_mktsegment")
    pick = F.conv(F.substring(F.md5(F.concat(F.lit("messy:"), F.col("c_custkey").cast("string"))), 1, 1), 16, 10).cast("int")
    cell = (F.when(pick == 0, F.concat(F.lit(" "), c, F.lit("  "))).when(pick == 1, "?").when(pick == 2, " ? ")
            .when(pick == 3, "").when(pick == 4, "   ").when(pick == 5, None).otherwise(c))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias(ROW), cell.alias("segment"), "c_acctbal")


MESSY_SQL = ("messy AS (SELECT c_custkey AS rid, CASE CAST('0x' || substr(md5('messy:' || c_custkey), 1, 1) AS BIGINT) "
             + " ".join(f"WHEN {k} THEN {v.format(c='c_mktsegment')}" for k, v in MESSY.items())
             + " ELSE c_mktsegment END AS segment, c_acctbal FROM customer)")


@query("WITH " + MESSY_SQL + """ SELECT rid, CASE WHEN trim(segment) IN ('?', '') THEN NULL ELSE trim(segment) END AS segment,
  c_acctbal FROM messy""")
def normalise_cells(spark: SparkSession, sf: str) -> DataFrame:
    return normalise(_messy_segments(spark, sf))


@query("WITH " + DIRTY_ORDERS + """ SELECT o_orderstatus AS target, count(*) AS n_rows,
  round(avg(o_totalprice), 4) AS avg_price, (SELECT count(*) - count(o_orderstatus) FROM dord) AS rows_dropped
  FROM dord WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def load_dataset_prep(spark: SparkSession, sf: str) -> DataFrame:
    spec = TaskSpec("o_orderstatus", "multiclass", id_columns=(ROW,), drop_columns=("o_custkey",))
    df, prep = load_dataset(dirty_orders(spark, sf)[0], spec)
    return df.groupBy(F.col("o_orderstatus").alias("target")).agg(
        F.count("*").alias("n_rows"), F.round(F.avg("o_totalprice"), 4).alias("avg_price")).withColumn(
        "rows_dropped", F.lit(prep["rows_dropped_missing_target"]).cast("bigint"))


@query("""WITH t AS (SELECT CASE WHEN bool_and(l_quantity = round(l_quantity)) OVER () THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
    ELSE CAST(l_quantity AS VARCHAR) END AS l_quantity,
  CASE WHEN bool_and(l_discount = round(l_discount)) OVER () THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR)
    ELSE CAST(l_discount AS VARCHAR) END AS l_discount, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  trim(l_returnflag) AS l_returnflag FROM lineitem)
  SELECT l_quantity, l_discount, l_linenumber, l_returnflag, count(*) AS n FROM t GROUP BY ALL""", name="canonical_text")
def canonical_text_query(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["l_quantity", "l_discount", "l_linenumber", "l_returnflag"]
    return canonical_text(table(spark, sf, "lineitem").select(cols), cols).groupBy(*cols).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS rid, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders", name="concat_files")
def concat_files_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two files of one table, the second with its columns in another order."""
    df = order_rows(spark, sf)
    train, test = df.where("o_orderstatus = 'F'"), df.where("o_orderstatus <> 'F'").select(*reversed(df.columns))
    paths = [scratch_path(spark, "train"), scratch_path(spark, "test")]
    for part, path in zip((train, test), paths):
        part.write.parquet(path)
    return concat_files([spark.read.parquet(p) for p in paths])


@query("WITH " + DIRTY_ORDERS + """ SELECT o_totalprice, o_orderpriority, CAST(o_orderstatus = 'F' AS INTEGER) AS y
  FROM dord WHERE o_orderstatus IS NOT NULL""", name="feature_target")
def feature_target_query(spark: SparkSession, sf: str) -> DataFrame:
    spec = TaskSpec("o_orderstatus", id_columns=(ROW,), drop_columns=("o_custkey",))
    df = dirty_orders(spark, sf)[0].where("o_orderstatus IS NOT NULL")
    return feature_target(df, spec, "F")
