"""The repair menu: finalised, fold-local and replayed."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidegate import constants as K
from tidegate.operators import repair as R
from tidegate.operators.folds import fixed_folds, training_sets
from tidegate.operators.inject import DefectSpec, inject
from tidegate.queries.base import (DIRTY_EVENTS, DIRTY_LINE, DIRTY_ORDERS, EVENT_COLS, EVENTS, LINE_COLS, ORDER_COLS, ORDERS, ROW, SEED,
                                   damage_sql, dirty_events, dirty_line, dirty_orders, event_rows, folds_sql, order_rows)
from tidegate.queries.detection import MAGIC, units_ctes, variants_ctes
from tidegate.queries.registry import held, query
from tidegate.sources.tables import table

GAPS = [DefectSpec("value_gap", "nulls", "value", 0.1), DefectSpec("type_gap", "nulls", "event_type", 0.1)]
GAPS_SQL = EVENTS + ", " + damage_sql("ev", "dev", EVENT_COLS, GAPS)


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    return inject(event_rows(spark, sf), GAPS, SEED, ROW)[0]


def _out(df: DataFrame, column: str) -> DataFrame:
    c = F.round(column, 6).alias(column) if isinstance(df.schema[column].dataType, T.DoubleType) else F.col(column)
    return df.select(ROW, c)


@query("WITH " + GAPS_SQL + " SELECT rid, round(coalesce(value, (SELECT avg(value) FROM dev)), 6) AS value FROM dev")
def repair_fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(gappy_events(spark, sf), "fill_mean", "value"), "value")


@query("WITH " + GAPS_SQL + " SELECT rid, round(coalesce(value, (SELECT median(value) FROM dev)), 6) AS value FROM dev")
def repair_fill_median(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(gappy_events(spark, sf), "fill_median", "value"), "value")


MODE_SQL = "(SELECT event_type FROM dev WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)"


@query("WITH " + GAPS_SQL + f" SELECT rid, coalesce(event_type, {MODE_SQL}) AS event_type FROM dev")
def repair_fill_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(gappy_events(spark, sf), "fill_mode", "event_type"), "event_type")


@query("WITH " + GAPS_SQL + " SELECT rid, coalesce(event_type, 'Unknown') AS event_type FROM dev")
def repair_fill_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(gappy_events(spark, sf), "fill_unknown", "event_type"), "event_type")


@query("WITH " + GAPS_SQL + ", " + folds_sql("dev", "f", "(event_type = 'click')") + """
  SELECT rid, fold_0 = 0 AS is_test, round(value, 6) AS value FROM f WHERE fold_0 = 0 OR value IS NOT NULL""")
def repair_drop_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Only training rows go; fold 0 is the test side and stays whole."""
    df = fixed_folds(gappy_events(spark, sf), F.col("event_type") == "click", ROW)
    test = F.col("fold_0") == 0
    train = R.finalise(df.where(~test), "drop_rows", "value")
    return train.unionByName(df.where(test)).select(ROW, test.alias("is_test"), F.round("value", 6).alias("value"))


@query("WITH " + EVENTS + """, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM ev)
  SELECT rid, round(CASE WHEN value IS NULL THEN NULL ELSE greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), value)) END, 6) AS value FROM ev, q""")
def repair_clip_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(event_rows(spark, sf), "clip_outliers", "value"), "value")


@query("WITH " + DIRTY_LINE + """ SELECT rid, CASE WHEN l_quantity = 9999 THEN
  (SELECT median(l_quantity) FROM dirty WHERE l_quantity <> 9999) ELSE l_quantity END AS l_quantity FROM dirty""")
def repair_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(dirty_line(spark, sf)[0], "sentinel_to_median", "l_quantity"), "l_quantity")


@query("WITH " + DIRTY_LINE + ", " + units_ctes("dirty", ("l_extendedprice",), "d") + """
  SELECT rid, round(CASE WHEN l_extendedprice > cut THEN l_extendedprice / factor ELSE l_extendedprice END, 6) AS l_extendedprice
  FROM dirty LEFT JOIN d_u ON true""")
def repair_rescale_units(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(dirty_line(spark, sf)[0], "rescale_units", "l_extendedprice"), "l_extendedprice")


@query("WITH " + DIRTY_ORDERS + ", " + variants_ctes("dord", ("o_orderpriority",), "v") + """
  SELECT rid, coalesce(canon, o_orderpriority) AS o_orderpriority FROM dord
  LEFT JOIN v_vk ON k = regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g')""")
def repair_normalize_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _out(R.finalise(dirty_orders(spark, sf)[0], "normalize_categories", "o_orderpriority"), "o_orderpriority")


@query("SELECT min(doc_id) AS doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents GROUP BY text, lang, n_chars")
def repair_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    return R.finalise(docs, "dedupe_rows", "*", "doc_id").select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query("WITH c(\"column\", dtype, num) AS (VALUES ('l_quantity', 'double', true), ('l_linenumber', 'int', true), "
       "('l_returnflag', 'string', false), ('l_shipdate', 'timestamp_ntz', false), ('nope', NULL, NULL)), o(op, kind) AS (VALUES "
       + ", ".join(f"('{o}', '{'num' if o in K.NUMERIC_ONLY_OPS else 'text' if o in K.TEXT_ONLY_OPS else 'row' if o == 'dedupe_rows' else 'any'}')"
                   for o in K.OPERATION_MENU) + ", ('invent', 'bad')) "
       "SELECT c.\"column\", op, CASE WHEN kind = 'bad' THEN false WHEN kind = 'row' THEN true WHEN num IS NULL THEN false "
       "WHEN kind = 'num' THEN num WHEN kind = 'text' THEN NOT num ELSE true END AS valid, "
       "(SELECT count(*) FROM lineitem) AS rows FROM c, o")
def op_validity(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    rows = []
    for c in ("l_quantity", "l_linenumber", "l_returnflag", "l_shipdate", "nope"):
        for op in (*K.OPERATION_MENU, "invent"):
            try:
                R.check_op(op, R._dtype(df, c), c)
                rows.append((c, op, True))
            except R.RepairError:
                rows.append((c, op, False))
    return spark.createDataFrame(rows, "column string, op string, valid boolean").withColumn("rows", F.lit(df.count()))


def _models_sql() -> str:
    return "m AS (SELECT r, f FROM range(3) a(r), range(5) b(f))"


LONG_FOLDS = """long AS (SELECT t.*, r, f, CASE r WHEN 0 THEN fold_0 WHEN 1 THEN fold_1 ELSE fold_2 END = f AS is_test FROM folded t, m)"""


@query("WITH " + DIRTY_LINE + ", " + folds_sql("dirty", "folded", "label") + ", " + _models_sql() + ", " + LONG_FOLDS + """,
  s AS (SELECT r, f, median(l_quantity) FILTER (NOT is_test AND l_quantity <> 9999) AS qmed, avg(l_discount) FILTER (NOT is_test) AS dmean,
    median(l_discount) FILTER (NOT is_test) AS dmed, quantile_cont(l_extendedprice, 0.25) FILTER (NOT is_test) AS p1,
    quantile_cont(l_extendedprice, 0.75) FILTER (NOT is_test) AS p3 FROM long GROUP BY r, f)
  SELECT CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold, round(qmed, 6) AS qty_median, round(dmean, 6) AS disc_mean, round(dmed, 6) AS disc_median,
    round(p1 - 1.5 * (p3 - p1), 6) AS price_low, round(p3 + 1.5 * (p3 - p1), 6) AS price_high,
    count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test,
    round(avg(CASE WHEN l_quantity = 9999 THEN qmed ELSE l_quantity END) FILTER (NOT is_test), 6) AS train_qty,
    round(avg(CASE WHEN l_quantity = 9999 THEN qmed ELSE l_quantity END) FILTER (is_test), 6) AS test_qty,
    round(avg(coalesce(l_discount, dmean)) FILTER (is_test), 6) AS test_disc
  FROM long JOIN s USING (r, f) GROUP BY ALL""")
def fold_fit_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics from each training fold, applied to its training and its test rows."""
    df = held(fixed_folds(dirty_line(spark, sf)[0], F.col("label"), ROW))
    models = training_sets()
    fits = {k: R.fit(df, op, c, models) for k, (op, c) in {
        "q": ("sentinel_to_median", "l_quantity"), "d": ("fill_mean", "l_discount"),
        "m": ("fill_median", "l_discount"), "p": ("clip_outliers", "l_extendedprice")}.items()}
    aggs = []
    for i, train in enumerate(models):
        q = R.repaired("sentinel_to_median", F.col("l_quantity"), fits["q"][i])
        d = R.repaired("fill_mean", F.col("l_discount"), fits["d"][i])
        aggs.append(F.struct(
            F.lit(i // 5).alias("repeat"), F.lit(i % 5).alias("fold"), F.lit(fits["q"][i]["median"]).alias("qty_median"),
            F.lit(fits["d"][i]["value"]).alias("disc_mean"), F.lit(fits["m"][i]["value"]).alias("disc_median"),
            F.lit(fits["p"][i]["low"]).alias("price_low"), F.lit(fits["p"][i]["high"]).alias("price_high"),
            F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.avg(F.when(train, q)).alias("train_qty"),
            F.avg(F.when(~train, q)).alias("test_qty"), F.avg(F.when(~train, d)).alias("test_disc")))
    out = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    places = {"price_low": 6, "price_high": 6, "qty_median": 6, "disc_mean": 6, "disc_median": 6, "train_qty": 6, "test_qty": 6, "test_disc": 6}
    return out.withColumns({c: F.round(c, p) for c, p in places.items()})


CHAIN = {"l_quantity": "sentinel_to_median", "l_extendedprice": "rescale_units", "l_returnflag": "normalize_categories",
         "l_discount": "drop_rows"}
FIXED_LINE = units_ctes("dirty", ("l_extendedprice",), "d") + ", " + variants_ctes("dirty", ("l_returnflag",), "v") + """,
  fixed AS (SELECT rid, CASE WHEN l_quantity = 9999 THEN (SELECT median(l_quantity) FROM dirty WHERE l_quantity <> 9999)
      ELSE l_quantity END AS l_quantity,
    CASE WHEN l_extendedprice > cut THEN l_extendedprice / factor ELSE l_extendedprice END AS l_extendedprice, l_discount, l_tax,
    coalesce(canon, l_returnflag) AS l_returnflag, label FROM dirty LEFT JOIN d_u ON true
    LEFT JOIN v_vk ON k = regexp_replace(lower(l_returnflag), '[^a-z0-9]', '', 'g') WHERE l_discount IS NOT NULL)"""


@query("WITH " + DIRTY_LINE + ", " + FIXED_LINE + """ SELECT rid, l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
  l_discount, l_tax, l_returnflag, label FROM fixed""", name="materialize_ops")
def materialize_ops(spark: SparkSession, sf: str) -> DataFrame:
    df = R.materialize(dirty_line(spark, sf)[0], CHAIN, ROW)
    return df.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


def _param(recipe: list[dict], column: str, key: str):
    return next(r for r in recipe if r["column"] == column)["params"].get(key)


@query("WITH " + DIRTY_LINE + ", " + FIXED_LINE + """ SELECT count(*) AS rows_out, round(sum(l_quantity), 4) AS qty,
  round(sum(l_extendedprice), 2) AS price, count(DISTINCT l_returnflag) AS flags, (SELECT count(*) FROM dirty) - count(*) AS rows_removed,
  (SELECT median(l_quantity) FROM dirty WHERE l_quantity <> 9999) AS qty_median, (SELECT round(cut, 4) FROM d_u) AS price_cut,
  true AS same_on_replay FROM fixed""")
def recipe_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Fit in order, save the recipe as JSON, read it back, replay without refitting."""
    from tidegate.sources.recipes import read_recipe, write_recipe
    from tidegate.session import scratch_path
    df = dirty_line(spark, sf)[0]
    cleaned, recipe = R.fit_recipe(df, CHAIN, ROW)
    path = scratch_path(spark, "recipe")
    write_recipe(spark, recipe, path)
    again = R.replay_recipe(df, read_recipe(spark, path), ROW)

    def facts(d, tag):
        return d.agg(F.count("*").alias("rows_out"), F.round(F.sum("l_quantity"), 4).alias("qty"),
                     F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count_distinct("l_returnflag").alias("flags"))
    a, b = facts(cleaned, "a").first(), facts(again, "b").first()
    return spark.createDataFrame(
        [(*a, sum(r["rows_removed"] for r in recipe), _param(recipe, "l_quantity", "median"),
          round(_param(recipe, "l_extendedprice", "cut"), 4), a == b)],
        "rows_out bigint, qty double, price double, flags bigint, rows_removed bigint, qty_median double, price_cut double, same_on_replay boolean")


@query("WITH " + DIRTY_ORDERS + ", " + folds_sql("dord", "f", "1") + """,
  tr AS (SELECT * FROM f WHERE fold_0 <> 0), te AS (SELECT * FROM f WHERE fold_0 = 0), """ + variants_ctes("tr", ("o_orderpriority",), "v") + """
  SELECT rid, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM tr)), 4) AS o_totalprice, coalesce(canon, o_orderpriority) AS o_orderpriority
  FROM te LEFT JOIN v_vk ON k = regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g')""")
def recipe_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters from one partition, applied to rows they have never seen."""
    df = fixed_folds(dirty_orders(spark, sf)[0], F.lit(1), ROW)
    _, recipe = R.fit_recipe(df.where("fold_0 <> 0"), {"o_totalprice": "fill_median", "o_orderpriority": "normalize_categories"}, ROW)
    out = R.replay_recipe(df.where("fold_0 = 0"), recipe, ROW)
    return out.select(ROW, F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderpriority")
