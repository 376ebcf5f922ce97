"""Preprocessing rules, steps, models and comparison."""
from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from tidegate import constants as K
from tidegate.operators.folds import fixed_folds
from tidegate.operators.inject import DefectSpec, inject
from tidegate.operators.metrics import brier, f1
from tidegate.plans import models as M
from tidegate.plans import prep as P
from tidegate.plans import recommend as R
from tidegate.plans.evaluate import arena, compare_preprocessing, spread
from tidegate.queries.base import LINE, LINE_COLS, ROW, SEED, damage_sql, folds_sql, line
from tidegate.queries.registry import held, query
from tidegate.queries.repairing import GAPS_SQL, gappy_events
from tidegate.session import scratch_path
from tidegate.sources.tables import table

FAMILIES = K.MODEL_FAMILIES


def _profile_sql(cols: dict[str, bool], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS c, {str(num).lower()} AS num, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS miss, "
        f"{f'coalesce(skewness({c}), 0)' if num else '0'} AS skew, count(DISTINCT {c}) AS nu FROM {src}" for c, num in cols.items())


EVENT_FEATURES = {"user_id": True, "value": True, "event_type": False, "props": False}
RULE_SQL = f"""prof AS ({_profile_sql(EVENT_FEATURES, 'wide')}), fam AS (SELECT unnest({list(FAMILIES)!r}) AS family),
  st AS (SELECT family, c, CASE WHEN miss = 0 THEN NULL WHEN num AND family = 'tree_ensemble' THEN 'imputation|IMP-N1|median+indicator' WHEN num AND abs(skew) > 1 THEN 'imputation|IMP-N2|median'
      WHEN num THEN 'imputation|IMP-N3|mean' WHEN miss >= 0.05 THEN 'imputation|IMP-C1|constant_missing' ELSE 'imputation|IMP-C2|most_frequent' END AS imp,
    CASE WHEN num THEN NULL WHEN family = 'tree_ensemble' THEN 'encoding|ENC-T1|ordinal' WHEN nu > 15 THEN 'encoding|ENC-H1|onehot_capped' ELSE 'encoding|ENC-L1|onehot' END AS enc,
    CASE WHEN NOT num THEN NULL WHEN family = 'tree_ensemble' THEN 'scaling|SCL-T1|none' WHEN abs(skew) > 1 AND family = 'distance' THEN 'scaling|SCL-D1|robust'
      ELSE 'scaling|SCL-G1|standard' END AS scl FROM prof, fam),
  steps AS (SELECT family, s, string_agg(c, ',' ORDER BY c) AS columns FROM (SELECT family, c, imp AS s FROM st UNION ALL SELECT family, c, enc FROM st UNION ALL SELECT family, c, scl FROM st)
    WHERE s IS NOT NULL GROUP BY 1, 2)"""
WIDE = GAPS_SQL + ", wide AS (SELECT d.rid, d.user_id, d.value, d.event_type, e.props, CASE WHEN d.user_id % 10 = 0 THEN 'rare' ELSE 'usual' END AS target FROM dev d JOIN events e ON e.event_id = d.rid)"


def wide_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias(ROW), "props")
    return gappy_events(spark, sf).join(e, ROW).withColumn("target", F.when(F.col("user_id") % 10 == 0, "rare").otherwise("usual"))


@query("WITH " + WIDE + ", " + RULE_SQL + """ SELECT family, gate, split_part(s, '|', 1) AS stage, split_part(s, '|', 2) AS rule_id, split_part(s, '|', 3) AS method, columns FROM steps,
    (VALUES ('brier'), ('f1')) g(gate)
  UNION ALL SELECT family, gate, 'imbalance', CASE WHEN family IN ('linear', 'tree_ensemble') THEN 'IMB-1' ELSE 'IMB-2' END,
    CASE WHEN family IN ('linear', 'tree_ensemble') THEN 'class_weight_balanced' ELSE 'none' END, '' FROM fam, (VALUES ('brier'), ('f1')) g(gate),
    (SELECT CAST(min(n) AS DOUBLE) / max(n) AS r FROM (SELECT count(*) AS n FROM wide GROUP BY target)) WHERE r < 0.25 AND (family NOT IN ('linear', 'tree_ensemble') OR gate = 'f1')""")
def recommend_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every family under a probability gate and under a label gate."""
    df = held(wide_events(spark, sf))
    parts = []
    for fam in FAMILIES:
        for gate in ("brier", "f1"):
            s = R.recommend_steps(df, list(EVENT_FEATURES), "target", "binary", fam, gate)
            parts.append(s.select(F.lit(fam).alias("family"), F.lit(gate).alias("gate"), "stage", "rule_id", "method", F.array_join("columns", ",").alias("columns")))
    return reduce(DataFrame.unionByName, parts)


SPLIT = GAPS_SQL + ", " + folds_sql("dev", "f", "1")
def in_train():
    return F.col("fold_0") != 0



def split_events(spark: SparkSession, sf: str) -> DataFrame:
    return held(fixed_folds(gappy_events(spark, sf), F.lit(1), ROW))


@query("WITH " + SPLIT + """ SELECT rid, round(coalesce(value, (SELECT avg(value) FROM f WHERE fold_0 <> 0)), 6) AS mean_fill,
  round(coalesce(value, (SELECT median(value) FROM f WHERE fold_0 <> 0)), 6) AS median_fill,
  coalesce(event_type, (SELECT event_type FROM f WHERE fold_0 <> 0 AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS top_fill,
  coalesce(event_type, '__missing__') AS constant_fill FROM f""")
def prep_impute(spark: SparkSession, sf: str) -> DataFrame:
    df = split_events(spark, sf).withColumns({"mean_fill": F.col("value"), "median_fill": F.col("value"), "top_fill": F.col("event_type"), "constant_fill": F.col("event_type")})
    for c, m in (("mean_fill", "mean"), ("median_fill", "median"), ("top_fill", "most_frequent"), ("constant_fill", "constant_missing")):
        df = P.impute(df, c, m, in_train())
    return df.select(ROW, F.round("mean_fill", 6).alias("mean_fill"), F.round("median_fill", 6).alias("median_fill"), "top_fill", "constant_fill")


@query("WITH " + SPLIT + """ SELECT rid, round(coalesce(value, (SELECT median(value) FROM f WHERE fold_0 <> 0)), 6) AS value, CAST(value IS NULL AS INTEGER) AS value_missing FROM f""")
def prep_indicator(spark: SparkSession, sf: str) -> DataFrame:
    return P.impute(split_events(spark, sf), "value", "median+indicator", in_train()).select(ROW, F.round("value", 6).alias("value"), "value_missing")


# a level that exists in test rows only: its code must be "unknown"
BRANDS = "pt0 AS (SELECT p_partkey AS rid, p_brand, p_type FROM part), " + folds_sql("pt0", "pf0", "1") + \
    ", pf AS (SELECT rid, p_type, fold_0, CASE WHEN fold_0 = 0 AND rid % 7 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand FROM pf0)"


def brands(spark: SparkSession, sf: str) -> DataFrame:
    df = fixed_folds(table(spark, sf, "part").select(F.col("p_partkey").alias(ROW), "p_brand", "p_type"), F.lit(1), ROW)
    return held(df.withColumn("p_brand", F.when((F.col("fold_0") == 0) & (F.col(ROW) % 7 == 0), "Brand#new").otherwise(F.col("p_brand"))))


@query("WITH " + BRANDS + """, l AS (SELECT DISTINCT p_brand AS level FROM pf WHERE fold_0 <> 0) SELECT rid, level AS p_brand_slot FROM pf LEFT JOIN l ON p_brand = level""")
def prep_onehot(spark: SparkSession, sf: str) -> DataFrame:
    return P.onehot(brands(spark, sf), "p_brand", in_train()).select(ROW, "p_brand_slot")


@query("WITH " + BRANDS + """, l AS (SELECT p_brand AS level, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk FROM pf WHERE fold_0 <> 0 GROUP BY 1),
  t AS (SELECT DISTINCT p_type AS level FROM pf WHERE fold_0 <> 0)
  SELECT rid, CASE WHEN (SELECT count(*) FROM l) > 15 THEN CASE WHEN rk <= 14 THEN p_brand ELSE 'infrequent' END ELSE l.level END AS p_brand_slot, t.level AS p_type_slot
  FROM pf LEFT JOIN l ON p_brand = l.level LEFT JOIN t ON p_type = t.level""")
def prep_onehot_capped(spark: SparkSession, sf: str) -> DataFrame:
    """25 brands are capped, 6 types are not."""
    df = P.onehot(P.onehot(brands(spark, sf), "p_brand", in_train(), K.HIGH_CARD), "p_type", in_train(), K.HIGH_CARD)
    return df.select(ROW, "p_brand_slot", "p_type_slot")


@query("WITH " + BRANDS + """, l AS (SELECT p_brand AS level, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM pf WHERE fold_0 <> 0))
  SELECT rid, CAST(coalesce(code, -1) AS INTEGER) AS p_brand_code FROM pf LEFT JOIN l ON p_brand = level""")
def prep_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return P.ordinal(brands(spark, sf), "p_brand", in_train()).select(ROW, F.col("p_brand_code").cast("int").alias("p_brand_code"))


LI_SPLIT = LINE + ", " + folds_sql("line", "f", "1")


def split_line(spark: SparkSession, sf: str) -> DataFrame:
    return held(fixed_folds(line(spark, sf), F.lit(1), ROW))


@query("WITH " + LI_SPLIT + """, s AS (SELECT avg(l_tax) AS a, stddev_pop(l_tax) AS b, avg(l_quantity) AS c, stddev_pop(l_quantity) AS d FROM f WHERE fold_0 <> 0)
  SELECT rid, round((l_tax - a) / b, 6) + 0.0 AS l_tax, round((l_quantity - c) / d, 6) + 0.0 AS l_quantity FROM f, s""")
def prep_standard(spark: SparkSession, sf: str) -> DataFrame:
    df = P.standard(split_line(spark, sf), ["l_tax", "l_quantity"], in_train())
    return df.select(ROW, (F.round("l_tax", 6) + 0.0).alias("l_tax"), (F.round("l_quantity", 6) + 0.0).alias("l_quantity"))


@query("WITH " + SPLIT + """, s AS (SELECT quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM f WHERE fold_0 <> 0)
  SELECT rid, round((value - m) / (b - a), 6) + 0.0 AS value FROM f, s""")
def prep_robust(spark: SparkSession, sf: str) -> DataFrame:
    return P.robust(split_events(spark, sf), ["value"], in_train()).select(ROW, (F.round("value", 6) + 0.0).alias("value"))


@query()
def prep_yeo_johnson(spark: SparkSession, sf: str) -> DataFrame:
    df, lam = P.yeo_johnson(split_events(spark, sf), "value", in_train())
    return df.select(ROW, F.round("value", 6).alias("value"), F.lit(round(lam, 4)).alias("lambda"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), d AS (SELECT t.vec_id, r.vec_id AS nb, r.label, list_distance(t.v, r.v) AS dist
    FROM e t JOIN e r ON t.vec_id % 5 = 0 AND r.vec_id % 5 <> 0), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, nb) <= 5),
  v AS (SELECT vec_id, label, count(*) AS n FROM k GROUP BY 1, 2) SELECT vec_id, arg_min(label, (-n, label)) AS predicted FROM v GROUP BY 1""")
def knn_predict(spark: SparkSession, sf: str) -> DataFrame:
    """One fifth of the vectors is classified from the rest; every vector is on one of the two sides."""
    e = table(spark, sf, "embeddings")
    return M.knn_classify(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), "vec_id", "embedding", "label")


@query()
def stage2_models(spark: SparkSession, sf: str) -> DataFrame:
    """Every family fitted on training rows, scored on test rows."""
    df = P.standard(split_line(spark, sf), ["l_quantity", "l_extendedprice", "l_tax"], in_train())
    feats = array_to_vector(F.array("l_quantity", "l_extendedprice", "l_tax"))
    rows = held(spread(df).select(ROW, (F.col("label") == "hi").cast("int").alias("y"), feats.alias("features"), "fold_0", "l_discount"))
    train, test = rows.where(in_train()), rows.where(~in_train())
    n, out = train.count(), []
    for fam in ("linear", "tree_ensemble", "neural"):
        p = vector_to_array("probability")[1]
        scored = M.make_estimator("binary", fam, 3, n).fit(train).transform(test)
        out.append(scored.agg(F.lit("binary").alias("task"), F.lit(fam).alias("family"), (-brier(p, F.col("y"))).alias("score"), F.count("*").alias("n_test")))
    for fam in ("linear", "tree_ensemble"):
        reg = lambda d: d.drop("y").withColumn("y", F.col("l_discount"))
        scored = M.make_estimator("regression", fam, 3, n).fit(reg(train)).transform(reg(test))
        out.append(scored.agg(F.lit("regression").alias("task"), F.lit(fam).alias("family"),
                              (-F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).alias("score"), F.count("*").alias("n_test")))
    return reduce(DataFrame.unionByName, out)


COMPARE_SPECS = [DefectSpec("tax_gap", "nulls", "l_tax", 0.08), DefectSpec("flag_gap", "nulls", "l_returnflag", 0.1)]


@query()
def stage2_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Recommended against default preprocessing on the fixed folds, with the fallback decision."""
    df, _ = inject(line(spark, sf), COMPARE_SPECS, SEED, ROW)
    a = arena(df, "label", "hi", ROW)
    held(a.df)
    steps = R.recommend_steps(df, [c for c in df.columns if c not in (ROW, "label")], "label", "binary", "linear").collect()   # a few rules
    rep = compare_preprocessing(a, [s.asDict() for s in steps])
    return R.decide(spark.createDataFrame([rep]))


@query("""WITH r AS (SELECT l_linenumber, l_returnflag, avg(l_tax) - 0.04 AS mean_diff, 0.0001 * l_linenumber AS se_corrected FROM lineitem GROUP BY 1, 2)
  SELECT l_linenumber, l_returnflag, mean_diff < -2.0 * CAST(se_corrected AS DOUBLE) AS fallback, CASE WHEN mean_diff < -2.0 * CAST(se_corrected AS DOUBLE) THEN 'default' ELSE 'recommended' END AS final FROM r""")
def stage2_decide(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg((F.avg("l_tax") - 0.04).alias("mean_diff")).withColumn(
        "se_corrected", F.lit(0.0001) * F.col("l_linenumber"))
    return R.decide(r).select("l_linenumber", "l_returnflag", "fallback", "final")


EDITS = [(0, "mean"), (2, "ordinal"), (3, "robust"), (3, "none"), (9, "median"), (1, "onehot")]
NUMBERED = ", num AS (SELECT row_number() OVER (ORDER BY CASE split_part(s, '|', 1) WHEN 'imputation' THEN 0 WHEN 'encoding' THEN 1 ELSE 2 END, split_part(s, '|', 2)) - 1 AS step, " \
    "split_part(s, '|', 1) AS stage, split_part(s, '|', 2) AS rule_id, split_part(s, '|', 3) AS method FROM steps WHERE family = 'linear'), ed(step, m) AS (VALUES " + \
    ", ".join(f"({s}, '{m}')" for s, m in EDITS) + "), bad AS (SELECT step, 'listed twice' AS problem FROM ed GROUP BY step HAVING count(*) > 1 UNION ALL SELECT step, 'does not exist' FROM ed " \
    "WHERE step NOT IN (SELECT step FROM num) UNION ALL SELECT ed.step, 'cannot become ' || m FROM ed JOIN num USING (step) WHERE NOT CASE WHEN rule_id LIKE 'IMP-N%' THEN " \
    "m IN ('median', 'mean', 'median+indicator') WHEN rule_id LIKE 'IMP-C%' THEN m IN ('most_frequent', 'constant_missing') WHEN stage = 'encoding' THEN " \
    "m IN ('onehot', 'onehot_capped', 'ordinal') ELSE m IN ('none', 'standard', 'robust', 'yeo_johnson') END)"


@query("WITH " + WIDE + ", " + RULE_SQL + NUMBERED + """, ok AS (SELECT * FROM ed WHERE step NOT IN (SELECT step FROM bad))
  SELECT CAST(step AS INTEGER) AS step, stage, rule_id, coalesce(m, method) AS method, CASE WHEN m IS NOT NULL AND m <> method THEN 'user_override' ELSE 'rule' END AS decided_by,
    CASE WHEN m <> method THEN method || ' -> ' || m END AS user_edit, CASE WHEN (SELECT count(*) FROM ok JOIN num USING (step) WHERE m <> method) > 0 THEN 'approved steps' ELSE 'default' END AS pipeline_used,
    CAST(NULL AS VARCHAR) AS problem FROM num LEFT JOIN ok USING (step)
  UNION ALL SELECT CAST(step AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL, problem FROM bad""")
def stage2_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Valid edits are applied, the others are listed with what is wrong with them."""
    df = held(wide_events(spark, sf))
    steps = R.recommend(R.profile_columns(df, list(EVENT_FEATURES)), "linear")
    numbered = held(steps.select((F.row_number().over(W.orderBy(R.stage_order(F.col("stage")), "rule_id")) - 1).alias("step"), "stage", "rule_id", "method",
                                 F.when(F.col("rule_id").startswith("IMP-C") | (F.col("stage") == "encoding"), "categorical").otherwise("numeric").alias("kind")))
    edits = spark.createDataFrame(EDITS, "step int, method string")
    bad = held(R.bad_edits(numbered, edits))
    good = edits.join(bad, "step", "left_anti")
    none = F.lit(None).cast("string")
    out = R.apply_edits(numbered, good, fallback=True).withColumn("problem", none)
    return out.unionByName(bad.select("step", *[none.alias(c) for c in out.columns[1:-1]], "problem"))
