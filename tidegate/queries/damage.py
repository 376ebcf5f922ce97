"""Declared damage and answer keys."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators.inject import DefectSpec, inject
from tidegate.queries.base import (DIRTY_LINE, DIRTY_ORDERS, EVENT_COLS, EVENTS, LINE, LINE_COLS, ORDER_COLS, ORDERS, ROW, SEED,
                                   damage_sql, dirty_line, dirty_orders, event_rows, line, order_rows)
from tidegate.queries.registry import query

RESPELL = [DefectSpec("respell", "category_variants", "o_orderpriority", 0.6)]
CODE = [DefectSpec("code", "sentinel", "value", 0.03, value=-999.0)]
UNITS = [DefectSpec("units", "mixed_units", "l_extendedprice", 0.15, factor=12)]
NULLS = [DefectSpec("gone", "nulls", "value", 0.2)]
# the second spec re-spells a column the first one has already damaged
TWICE = [DefectSpec("first", "nulls", "o_orderpriority", 0.1), DefectSpec("second", "category_variants", "o_orderpriority", 0.5)]


@query("WITH " + ORDERS + ", " + damage_sql("ord", "d", ORDER_COLS, RESPELL) + " SELECT rid, o_orderpriority FROM d")
def inject_respell(spark: SparkSession, sf: str) -> DataFrame:
    return inject(order_rows(spark, sf), RESPELL, SEED, ROW)[0].select(ROW, "o_orderpriority")


@query("WITH " + EVENTS + ", " + damage_sql("ev", "d", EVENT_COLS, CODE) + " SELECT rid, value FROM d")
def inject_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return inject(event_rows(spark, sf), CODE, SEED, ROW)[0].select(ROW, "value")


@query("WITH " + LINE + ", " + damage_sql("line", "d", LINE_COLS, UNITS) + " SELECT rid, round(l_extendedprice, 4) AS l_extendedprice FROM d")
def inject_units(spark: SparkSession, sf: str) -> DataFrame:
    return inject(line(spark, sf), UNITS, SEED, ROW)[0].select(ROW, F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("WITH " + EVENTS + ", " + damage_sql("ev", "d", EVENT_COLS, NULLS) + " SELECT rid, value FROM d")
def inject_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return inject(event_rows(spark, sf), NULLS, SEED, ROW)[0].select(ROW, "value")


@query("WITH " + ORDERS + ", " + damage_sql("ord", "d1", ORDER_COLS, TWICE[:1]) + ", " + damage_sql("d1", "d2", ORDER_COLS, TWICE[1:])
       + ", " + damage_sql("ord", "dord", ORDER_COLS, [DefectSpec("total", "nulls", "o_totalprice", 0.06)])
       + " SELECT * FROM d1_key UNION ALL SELECT * FROM d2_key UNION ALL SELECT * FROM dord_key")
def inject_manifest(spark: SparkSession, sf: str) -> DataFrame:
    specs = TWICE + [DefectSpec("total", "nulls", "o_totalprice", 0.06)]
    return inject(order_rows(spark, sf), specs, SEED, ROW)[1]
