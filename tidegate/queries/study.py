"""Grading against answer keys, outcomes, designation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate import constants as K
from tidegate.functions.quantiles import Ask, exact_quantiles
from tidegate.operators import compare as C
from tidegate.operators import repair as R
from tidegate.operators.detect import detect, spelling_groups
from tidegate.functions.text import norm_key
from tidegate.operators.folds import fixed_folds
from tidegate.operators.inject import inject
from tidegate.plans import study as S
from tidegate.queries.base import (DIRTY_LINE, DIRTY_ORDERS, LINE, LINE_COLS, LINE_SPECS, ROW, damage_sql, dirty_line, dirty_orders,
                                   folds_sql, line)
from tidegate.queries.detection import units_ctes, variants_ctes
from tidegate.queries.registry import held, query
from tidegate.sources.tables import table

FIXES = {"l_quantity": "sentinel_to_median", "l_extendedprice": "rescale_units", "l_returnflag": "normalize_categories",
         "l_discount": "fill_median"}


def fixed_ctes(src: str = "dirty", out: str = "fixed", fit: str | None = None) -> str:
    """<out>: <src> after FIXES, parameters fitted on <fit>."""
    fit = fit or src
    key = "regexp_replace(lower(l_returnflag), '[^a-z0-9]', '', 'g')"
    return (units_ctes(fit, ("l_extendedprice",), out + "u") + ", " + variants_ctes(fit, ("l_returnflag",), out + "v") + f""",
      {out} AS (SELECT rid, CASE WHEN l_quantity = 9999 THEN (SELECT median(l_quantity) FROM {fit} WHERE l_quantity <> 9999) ELSE l_quantity END AS l_quantity,
        CASE WHEN l_extendedprice > cut THEN l_extendedprice / factor ELSE l_extendedprice END AS l_extendedprice,
        coalesce(l_discount, (SELECT median(l_discount) FROM {fit})) AS l_discount, l_tax, coalesce(canon, l_returnflag) AS l_returnflag, label
        FROM {src} LEFT JOIN {out}u_u ON true LEFT JOIN {out}v_vk ON k = {key})""")


FIXED = fixed_ctes()
VALUES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "label")


def repaired_line(spark: SparkSession, sf: str):
    """(truth, corrupted, cleaned, manifest)."""
    truth = line(spark, sf)
    dirty, key = dirty_line(spark, sf)
    return truth, dirty, held(R.materialize(dirty, FIXES, ROW)), held(key)


@query("WITH " + DIRTY_ORDERS + " SELECT * FROM dord WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL")
def complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    return dirty_orders(spark, sf)[0].dropna()


@query("WITH " + DIRTY_LINE + """ SELECT count(*) FILTER (d.l_quantity IS DISTINCT FROM t.l_quantity) AS l_quantity,
  count(*) FILTER (d.l_discount IS DISTINCT FROM t.l_discount) AS l_discount, count(*) FILTER (d.l_tax IS DISTINCT FROM t.l_tax) AS l_tax,
  count(*) FILTER (d.l_discount IS NULL) AS nulls FROM dirty d JOIN line t USING (rid)""")
def cell_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    both = C.side_by_side(dirty_line(spark, sf)[0], line(spark, sf), ROW, ["l_quantity", "l_discount", "l_tax"])
    return both.agg(*[F.count_if(C.mismatch(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(c) for c in ("l_quantity", "l_discount", "l_tax")],
                    F.count_if(F.col("a.l_discount").isNull()).alias("nulls"))


WRONG = " UNION ALL ".join(f"SELECT f.rid, '{c}' AS \"column\" FROM fixed f JOIN line t USING (rid) WHERE f.{c} IS DISTINCT FROM t.{c}" for c in VALUES)


@query("WITH " + DIRTY_LINE + ", " + FIXED + f""", wrong AS ({WRONG}) SELECT k.defect_id, 0 AS rows_dropped,
  (SELECT count(*) FROM wrong) - count(w.rid) AS collateral_cells, count(*) AS injected_rows, count(*) AS injected_rows_present
  FROM dirty_key k LEFT JOIN wrong w ON k.row_id = w.rid AND k."column" = w."column" GROUP BY 1""")
def grade_collateral(spark: SparkSession, sf: str) -> DataFrame:
    truth, _, cleaned, key = repaired_line(spark, sf)
    return C.grade_collateral(truth, cleaned, key, ROW)


def _cells(c: str) -> str:
    return (f"SELECT t.{c} AS o, d.{c} AS d, f.{c} AS n FROM dirty_key k JOIN line t ON k.row_id = t.rid JOIN dirty d ON d.rid = t.rid "
            f"JOIN fixed f ON f.rid = t.rid WHERE k.\"column\" = '{c}'")


@query("WITH " + DIRTY_LINE + ", " + FIXED + f""" SELECT 'l_extendedprice' AS "column", round(avg(CAST(abs(n - o) <= 0.5 AS INTEGER)), 6) AS restored_share
  FROM ({_cells('l_extendedprice')}) UNION ALL SELECT 'l_returnflag', round(avg(CAST(n = o AS INTEGER)), 6) FROM ({_cells('l_returnflag')})""")
def grade_restored(spark: SparkSession, sf: str) -> DataFrame:
    truth, bad, cleaned, key = repaired_line(spark, sf)
    out = None
    for c, kind in (("l_extendedprice", "mixed_units"), ("l_returnflag", "category_variants")):
        part = C.restored_share(C.graded_cells(truth, bad, cleaned, key, c, ROW), kind).select(
            F.lit(c).alias("column"), F.round("restored_share", 6).alias("restored_share"))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH " + DIRTY_LINE + ", " + FIXED + f""" SELECT round(avg(abs(n - o)), 4) AS mae, round(avg(abs(o - (SELECT median(l_quantity) FROM line))), 4)
  AS mae_median_reference, round(avg(abs(d - o)), 4) AS mae_unrepaired FROM ({_cells('l_quantity')})""")
def grade_mae(spark: SparkSession, sf: str) -> DataFrame:
    truth, bad, cleaned, key = repaired_line(spark, sf)
    median = exact_quantiles(truth, [Ask("q", F.col("l_quantity"))])["q"][0]
    m = C.mae_triple(C.graded_cells(truth, bad, cleaned, key, "l_quantity", ROW), median)
    return m.select([F.round(c, 4).alias(c) for c in m.columns])


CONFIRM = (LINE + ", " + folds_sql("line", "parts", "label") + ", pil AS (SELECT " + ", ".join(LINE_COLS) + " FROM parts WHERE fold_0 = 0), "
           "evl AS (SELECT " + ", ".join(LINE_COLS) + " FROM parts WHERE fold_0 <> 0), " + damage_sql("evl", "ed", LINE_COLS, LINE_SPECS, "201") + ", "
           + damage_sql("pil", "pd", LINE_COLS, LINE_SPECS, "301") + ", " + fixed_ctes("pd", "fixed", "ed"))


@query("WITH " + CONFIRM + """ SELECT (SELECT count(*) FROM pd_key) AS injected, count(*) FILTER (f.l_quantity IS DISTINCT FROM t.l_quantity) AS wrong_quantity,
  count(*) FILTER (abs(f.l_extendedprice - t.l_extendedprice) > 0.5) AS wrong_price, count(*) FILTER (f.l_returnflag <> t.l_returnflag) AS wrong_flag,
  round(avg(abs(f.l_quantity - t.l_quantity)), 6) AS mae FROM fixed f JOIN line t USING (rid)""")
def confirm_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Repairs fitted on the evaluation partition, applied to fresh damage on the pilot partition."""
    truth = held(fixed_folds(line(spark, sf), F.col("label"), ROW))
    cols = [ROW, *VALUES]
    ev, _ = inject(truth.where("fold_0 <> 0").select(cols), LINE_SPECS, "201", ROW)
    pil, key = inject(truth.where("fold_0 = 0").select(cols), LINE_SPECS, "301", ROW)
    _, recipe = R.fit_recipe(held(ev), FIXES, ROW)
    cleaned = R.replay_recipe(pil, recipe, ROW)
    both = C.side_by_side(cleaned, truth.select(cols), ROW, list(VALUES))
    return both.agg(F.lit(key.count()).alias("injected"), F.count_if(C.mismatch(F.col("a.l_quantity"), F.col("b.l_quantity"))).alias("wrong_quantity"),
                    F.count_if(F.abs(F.col("a.l_extendedprice") - F.col("b.l_extendedprice")) > 0.5).alias("wrong_price"),
                    F.count_if(F.col("a.l_returnflag") != F.col("b.l_returnflag")).alias("wrong_flag"),
                    F.round(F.avg(F.abs(F.col("a.l_quantity") - F.col("b.l_quantity"))), 6).alias("mae"))


# ---------------------------------------------------------------- outcomes: one study run per order

RUNS = """runs AS (SELECT o_orderkey AS run, 'C' || (o_custkey % 5 + 1) AS scenario, o_custkey % 5 <> 3 AS expected, o_orderstatus = 'F' AS hit,
  o_orderstatus <> 'O' AS any_commit, -0.10 - (o_orderkey % 7) / 1000.0 AS clean, -0.10 - (o_orderkey % 11) / 500.0 AS injected,
  -0.10 - (o_orderkey % 13) / 700.0 AS final FROM orders)"""
RUN_TYPES = "CAST(clean AS DOUBLE)"


def study_runs(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("run"), F.concat(F.lit("C"), (c % 5 + 1).cast("string")).alias("scenario"), (c % 5 != 3).alias("expected"),
        (F.col("o_orderstatus") == "F").alias("hit"), (F.col("o_orderstatus") != "O").alias("any_commit"),
        (F.lit(-0.10) - (k % 7) / F.lit(1000.0)).alias("clean"), (F.lit(-0.10) - (k % 11) / F.lit(500.0)).alias("injected"),
        (F.lit(-0.10) - (k % 13) / F.lit(700.0)).alias("final"))


LABEL = "CASE WHEN expected AND hit THEN 'hit' WHEN expected THEN 'miss' WHEN NOT any_commit THEN 'correct_rollback' ELSE 'false_commit' END"


@query("WITH " + RUNS + f" SELECT run, scenario, {LABEL} AS label FROM runs")
def outcome_label(spark: SparkSession, sf: str) -> DataFrame:
    return study_runs(spark, sf).select("run", "scenario", S.outcome_label(F.col("expected"), F.col("hit"), F.col("any_commit")).alias("label"))


@query("WITH " + RUNS + f" SELECT scenario, {LABEL} AS label, count(*) AS n FROM runs GROUP BY ALL")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    label = S.outcome_label(F.col("expected"), F.col("hit"), F.col("any_commit"))
    return study_runs(spark, sf).groupBy("scenario", label.alias("label")).agg(F.count("*").alias("n"))


@query("WITH " + RUNS + """ SELECT run, CASE WHEN CAST(clean - injected AS DOUBLE) > 1e-9 THEN round(CAST(final - injected AS DOUBLE) / CAST(clean - injected AS DOUBLE), 6) + 0.0 END
  AS recovery FROM runs""")
def recovery_fraction(spark: SparkSession, sf: str) -> DataFrame:
    r = S.recovery_fraction(F.col("clean"), F.col("injected"), F.col("final"))
    return study_runs(spark, sf).select("run", (F.round(r, 6) + F.lit(0.0)).alias("recovery"))


@query("""WITH l AS (SELECT 'S' || (l_linenumber % 4) AS scenario, CAST(l_discount AS DOUBLE) AS rate, avg(l_tax) / 20 AS effect, 0.0005 AS se,
    0.0010 + (l_linenumber % 4) * 0.0005 AS bar, l_linenumber % 4 <> 3 AS has_fix FROM lineitem GROUP BY 1, 2, l_linenumber % 4),
  m AS (SELECT *, has_fix AND effect >= bar * sqrt(0.25) + 0.84 * se * sqrt(0.25) AS ok FROM l)
  SELECT scenario, CASE WHEN count(*) FILTER (ok) > 0 THEN 'positive' ELSE 'negative' END AS designation,
  coalesce(min(rate) FILTER (ok), max(rate)) AS rate FROM m GROUP BY 1""")
def pilot_designation(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("l_linenumber") % 4
    ladder = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("S"), s.cast("string")).alias("scenario"), F.col("l_discount").alias("rate"), s.alias("s")).agg(
        (F.avg("l_tax") / 20).alias("effect")).select(
        "scenario", "rate", "effect", F.lit(0.0005).alias("se"), (F.lit(0.001) + F.col("s") * 0.0005).alias("bar"), (F.col("s") != 3).alias("has_fix"))
    return S.designate(ladder, 1, 4)


COMMITTED = [("l_quantity", "sentinel_to_median"), ("l_extendedprice", "clip_outliers"), ("l_returnflag", "normalize_categories")]


@query("WITH " + DIRTY_LINE + """ SELECT defect_id, "column", count(*) AS rows, CASE "column" WHEN 'l_quantity' THEN 'sentinel_to_median'
  WHEN 'l_extendedprice' THEN 'clip_outliers' WHEN 'l_returnflag' THEN 'normalize_categories' END AS got, CASE defect_id WHEN 'q_code' THEN 'mended'
  WHEN 'price_units' THEN 'wrongly mended by clip_outliers' WHEN 'flag_spelling' THEN 'needlessly changed by normalize_categories' ELSE 'rightly left' END
  AS verdict FROM dirty_key GROUP BY 1, 2""")
def answer_key_check(spark: SparkSession, sf: str) -> DataFrame:
    committed = spark.createDataFrame(COMMITTED, "column string, operation string")
    return S.answer_key_check(dirty_line(spark, sf)[1], committed, LINE_SPECS)


@query("WITH " + DIRTY_LINE + ", " + variants_ctes("dirty", ("l_returnflag",), "v") + """, flag AS (SELECT 'l_quantity' AS c, rid FROM dirty WHERE l_quantity = 9999
    UNION ALL SELECT 'l_returnflag', rid FROM dirty JOIN v_vk ON k = regexp_replace(lower(l_returnflag), '[^a-z0-9]', '', 'g') WHERE l_returnflag <> canon),
  k AS (SELECT * FROM dirty_key WHERE defect_id IN ('q_code', 'flag_spelling', 'disc_null'))
  SELECT k.defect_id, k."column", k.defect_id <> 'disc_null' AS detected,
    round(count(f.rid) / greatest((SELECT count(*) FROM flag x WHERE x.c = k."column"), 1), 6) AS precision, round(count(f.rid) / count(*), 6) AS recall
  FROM k LEFT JOIN flag f ON f.c = k."column" AND f.rid = k.row_id GROUP BY 1, 2""")
def detection_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Detected defects row by row; a defect whose finding has another name counts as missed."""
    df, key = dirty_line(spark, sf)
    findings = held(detect(df, "label", ROW))
    code = findings.where("defect = 'sentinel' AND column = 'l_quantity'").select(F.col("detail")["value"].cast("double").alias("v"))
    by_code = df.join(F.broadcast(code), df["l_quantity"] == code["v"]).select(F.lit("l_quantity").alias("column"), F.col(ROW).alias("row_id"))
    canon = held(spelling_groups(df, ["l_returnflag"]).select("key", "canonical"))
    canon.count()         # kept and counted, so Spark knows its size and sends a small one to the rows, not all rows to a few keys
    by_form = df.withColumn("key", norm_key(F.col("l_returnflag"))).join(canon, "key").where("l_returnflag <> canonical").select(
        F.lit("l_returnflag").alias("column"), F.col(ROW).alias("row_id"))
    out = C.detection_check(findings, key.where("defect_id <> 'price_units'"), by_code.unionByName(by_form))
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))
