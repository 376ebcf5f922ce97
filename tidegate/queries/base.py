"""Base tables of the registered queries: each is defined once for Spark and once in SQL.

The given tables are clean, so most queries first add declared damage to them. The damage
follows a seeded md5 order, which any SQL engine can reproduce row for row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.functions.hashing import hash_unit
from tidegate.operators.inject import DefectSpec, inject
from tidegate.queries.registry import held
from tidegate.sources.tables import one_task_per_core, table

SEED = "7"
ROW = "rid"

LINE_SPECS = [
    DefectSpec("q_code", "sentinel", "l_quantity", 0.05, value=9999.0, expected_fix="sentinel_to_median"),
    DefectSpec("price_units", "mixed_units", "l_extendedprice", 0.10, factor=1000, expected_fix="rescale_units"),
    DefectSpec("flag_spelling", "category_variants", "l_returnflag", 0.30, expected_fix="normalize_categories",
               expected_commit=False),
    DefectSpec("disc_null", "nulls", "l_discount", 0.04, expected_fix="fill_median", expected_commit=False),
]
ORDER_SPECS = [
    DefectSpec("prio_spelling", "category_variants", "o_orderpriority", 0.30, expected_fix="normalize_categories"),
    DefectSpec("total_null", "nulls", "o_totalprice", 0.06),
    DefectSpec("status_null", "nulls", "o_orderstatus", 0.05),
]
EVENT_SPECS = [DefectSpec("value_cap", "sentinel", "value", 0.05, value=500.0)]


def line(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a row id and a label that depends on the quantity."""
    li = one_task_per_core(table(spark, sf, "lineitem"))
    rid = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    keyed = li.withColumn(ROW, rid)
    score = F.lit(0.6) * F.col("l_quantity") / F.lit(50.0) + F.lit(0.4) * hash_unit("label", ROW)
    return keyed.select(ROW, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                        F.when(score > 0.5, "hi").otherwise("lo").alias("label"))


LINE = """line_0 AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS rid,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem),
line AS (SELECT *, CASE WHEN CAST(0.6 AS DOUBLE) * l_quantity / CAST(50 AS DOUBLE) + CAST(0.4 AS DOUBLE)
    * (CAST('0x' || substr(md5('label:' || rid), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)) > 0.5
    THEN 'hi' ELSE 'lo' END AS label FROM line_0)"""
LINE_COLS = ["rid", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "label"]


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(ROW), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


ORDERS = "ord AS (SELECT o_orderkey AS rid, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders)"
ORDER_COLS = ["rid", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias(ROW), "user_id", "event_type", "value")


EVENTS = "ev AS (SELECT event_id AS rid, user_id, event_type, value FROM events)"
EVENT_COLS = ["rid", "user_id", "event_type", "value"]


def dirty_line(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df, key = inject(held(line(spark, sf)), LINE_SPECS, SEED, ROW)
    return held(df), key


def dirty_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return inject(order_rows(spark, sf), ORDER_SPECS, SEED, ROW)


def dirty_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return inject(event_rows(spark, sf), EVENT_SPECS, SEED, ROW)


# ---------------------------------------------------------------- SQL twins

def hash_sql(seed: str, rid: str = "rid") -> str:
    return f"md5('{seed}:' || CAST({rid} AS VARCHAR))"


def damage_sql(src: str, out: str, cols: list[str], specs: list[DefectSpec], seed: str = SEED) -> str:
    """CTEs <out>_rank, <out> (damaged table) and <out>_key (answer key)."""
    ranks, values, keys = [], [], []
    new = {}
    for s in specs:
        part = f"PARTITION BY {s.column} IS NULL " if s.kind == "category_variants" else ""
        h = hash_sql(f"{seed}:{s.id}")
        ranks.append(f"row_number() OVER ({part}ORDER BY {h}, rid) AS k_{s.id}")
        total = f"(SELECT count({s.column if s.kind == 'category_variants' else '*'}) FROM {src})"
        hit = f"k_{s.id} <= round_even(CAST({s.rate} AS DOUBLE) * {total}, 0)"
        if s.kind == "category_variants":
            v = f"(CAST('0x' || substr({h}, 32, 1) AS BIGINT) % 4)"
            expr = (f"CASE {v} WHEN 0 THEN lower({s.column}) WHEN 1 THEN upper({s.column}) "
                    f"WHEN 2 THEN replace({s.column}, '-', ' ') ELSE replace(lower({s.column}), '-', ' ') END")
            hit += f" AND {s.column} IS NOT NULL AND {expr} <> {s.column}"
        elif s.kind == "sentinel":
            expr = f"CAST({s.value} AS DOUBLE)"
        elif s.kind == "mixed_units":
            expr = f"{s.column} * CAST({s.factor} AS DOUBLE)"
        else:
            expr = "NULL"
        new[s.column] = f"CASE WHEN {hit} THEN {expr} ELSE {s.column} END AS {s.column}"
        keys.append(f"SELECT '{s.id}' AS defect_id, '{s.kind}' AS kind, '{s.column}' AS \"column\", rid AS row_id, "
                    f"CAST({s.column} AS VARCHAR) AS original FROM {out}_rank WHERE {hit}")
    values = [new.get(c, c) for c in cols]
    return (f"{out}_rank AS (SELECT *, {', '.join(ranks)} FROM {src}),\n"
            f"{out} AS (SELECT {', '.join(values)} FROM {out}_rank),\n"
            f"{out}_key AS ({' UNION ALL '.join(keys)})")


DIRTY_LINE = LINE + ",\n" + damage_sql("line", "dirty", LINE_COLS, LINE_SPECS)
DIRTY_ORDERS = ORDERS + ",\n" + damage_sql("ord", "dord", ORDER_COLS, ORDER_SPECS)
DIRTY_EVENTS = EVENTS + ",\n" + damage_sql("ev", "dev", EVENT_COLS, EVENT_SPECS)


def folds_sql(src: str, out: str, cls: str, seed: str = "42", repeats: int = 3, splits: int = 5) -> str:
    """CTE <out>: <src> plus fold_0.. in the order of functions.hashing.ranked_in_class."""
    width = 26 // repeats
    digits = (f"(SELECT CAST(greatest(0, least(6, floor(log(greatest(count(*), 1) / 4096.0) / log(16) + 1e-9))) AS INTEGER) "
              f"FROM {src})")
    h = hash_sql(seed)
    folds = ", ".join(
        f"CAST((row_number() OVER (PARTITION BY {cls} ORDER BY substr(_h, 1, _d), substr(_h, {7 + r * width}, {width}), rid) - 1) "
        f"% {splits} AS INTEGER) AS fold_{r}" for r in range(repeats))
    return (f"{out}_h AS (SELECT *, {h} AS _h, {digits} AS _d FROM {src}),\n"
            f"{out} AS (SELECT * EXCLUDE (_h, _d), {folds} FROM {out}_h)")
