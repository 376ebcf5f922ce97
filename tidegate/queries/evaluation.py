"""Folds, in-fold encoding, scores and paired decisions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate import constants as K
from tidegate.functions.stats import t_quantile
from tidegate.operators import metrics as M
from tidegate.operators import repair as R
from tidegate.operators.folds import fixed_folds, grouped_split, holdout_split, partition_fingerprint, training_sets
from tidegate.plans.rate_table import rate_scores
from tidegate.queries.base import DIRTY_LINE, DIRTY_ORDERS, LINE, ROW, dirty_line, dirty_orders, folds_sql, line
from tidegate.queries.registry import held, query
from tidegate.queries.repairing import LONG_FOLDS, _models_sql
from tidegate.sources.tables import table

T15 = t_quantile(1 - K.ALPHA / K.MAX_ITERATIONS, 14)
CI14 = t_quantile(K.CI_LEVEL, 14)


@query("WITH " + LINE + ", " + folds_sql("line", "f", "label") + " SELECT rid, label, fold_0, fold_1, fold_2 FROM f", name="fixed_folds")
def fixed_folds_query(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_folds(line(spark, sf), F.col("label"), ROW).select(ROW, "label", "fold_0", "fold_1", "fold_2")


def _ranked(src: str, rid: str, seed: str, cls: str, out: str) -> str:
    d = f"(SELECT CAST(greatest(0, least(6, floor(log(greatest(count(*), 1) / 4096.0) / log(16) + 1e-9))) AS INTEGER) FROM {src})"
    return (f"{out}_h AS (SELECT *, md5('{seed}:' || CAST({rid} AS VARCHAR)) AS _h, {d} AS _d FROM {src}), "
            f"{out} AS (SELECT *, row_number() OVER (PARTITION BY {cls} ORDER BY substr(_h, 1, _d), substr(_h, 7, 26), {rid}) - 1 AS _r, "
            f"count(*) OVER (PARTITION BY {cls}) AS _n FROM {out}_h)")


@query("WITH " + DIRTY_ORDERS + ", " + _ranked("dord", "rid", "hold", "o_orderstatus", "r")
       + " SELECT rid, o_orderstatus, _r < round_even(CAST(0.2 AS DOUBLE) * _n, 0) AS is_test FROM r", name="holdout_split")
def holdout_query(spark: SparkSession, sf: str) -> DataFrame:
    return holdout_split(dirty_orders(spark, sf)[0], F.col("o_orderstatus"), ROW, "hold").select(ROW, "o_orderstatus", "is_test")


GROUPED = ("g0 AS (SELECT event_id AS rid, md5(coalesce(length(event_type) || ':' || event_type, '-') || coalesce(length(user_id::VARCHAR) || ':' || user_id::VARCHAR, '-') || "
           "coalesce(length((CASE WHEN NOT value > 100 THEN CAST(floor(value / 10) AS BIGINT)::VARCHAR END)) || ':' || (CASE WHEN NOT value > 100 THEN CAST(floor(value / 10) AS BIGINT)::VARCHAR END), '-')) AS g, CASE WHEN props LIKE '%1%' THEN 'a' ELSE 'b' END AS label FROM events), "
           "g1 AS (SELECT g, arg_min(label, rid) AS cls FROM g0 GROUP BY g), "
           "gd AS (SELECT CAST(greatest(0, least(6, floor(log(greatest(count(*), 1) / 4096.0) / log(16) + 1e-9))) AS INTEGER) AS _d FROM g0), "
           "gh AS (SELECT *, md5('split:' || g) AS _h FROM g1, gd), "
           "gr AS (SELECT g, row_number() OVER (PARTITION BY cls ORDER BY substr(_h, 1, _d), substr(_h, 7, 26), g) - 1 AS _r, "
           "count(*) OVER (PARTITION BY cls) AS _n FROM gh), "
           "split AS (SELECT rid, label, _r < round_even(CAST(0.2 AS DOUBLE) * _n, 0) AS is_pilot FROM g0 JOIN gr USING (g))")


def event_groups(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    df = e.select(F.col("event_id").alias(ROW), "event_type", "user_id",
                  F.when(~(F.col("value") > 100), F.floor(F.col("value") / 10).cast("bigint")).alias("band"),
                  F.when(F.col("props").like("%1%"), "a").otherwise("b").alias("label"))
    return grouped_split(df, ["event_type", "user_id", "band"], "label", ROW, "split")


@query("WITH " + GROUPED + " SELECT rid, label, is_pilot FROM split", name="grouped_split")
def grouped_split_query(spark: SparkSession, sf: str) -> DataFrame:
    return event_groups(spark, sf).select(ROW, "label", "is_pilot")


@query("WITH " + GROUPED + """ SELECT is_pilot, count(*) AS n_rows,
  bit_xor(CAST('0x' || substr(md5(CAST(rid AS VARCHAR)), 1, 15) AS BIGINT)) AS fingerprint FROM split GROUP BY 1""", name="partition_fingerprint")
def fingerprint_query(spark: SparkSession, sf: str) -> DataFrame:
    df = event_groups(spark, sf)
    return df.groupBy("is_pilot").agg(F.count("*").alias("n_rows"), partition_fingerprint(df, ROW).alias("fingerprint"))


# ---------------------------------------------------------------- scores on the rate table

def _score_sql(src: str, bucket: str, out: str) -> str:
    """CTE <out>(r, f, nb, f1, n_train, n_test)."""
    return f"""{out}_l AS (SELECT {bucket} AS b, CAST(label = 'hi' AS INTEGER) AS y, r, f, CASE r WHEN 0 THEN fold_0 WHEN 1 THEN fold_1 ELSE fold_2 END = f AS t
      FROM {src}, m),
    {out}_p AS (SELECT r, f, b, avg(y) FILTER (NOT t) AS rate FROM {out}_l GROUP BY r, f, b),
    {out}_s AS (SELECT r, f, y, coalesce(rate, (SELECT avg(CAST(label = 'hi' AS INTEGER)) FROM {src})) AS p FROM {out}_l
      JOIN {out}_p USING (r, f) WHERE t AND {out}_l.b IS NOT DISTINCT FROM {out}_p.b),
    {out} AS (SELECT r, f, -avg((p - y) ** 2) AS nb, coalesce(2.0 * count(*) FILTER (p >= 0.5 AND y = 1) / nullif(2 * count(*) FILTER
      (p >= 0.5 AND y = 1) + count(*) FILTER (p >= 0.5 AND y = 0) + count(*) FILTER (p < 0.5 AND y = 1), 0), 0) AS f1,
      (SELECT count(*) FROM {src}) - count(*) AS n_train, count(*) AS n_test FROM {out}_s GROUP BY r, f)"""


SCORES = DIRTY_LINE + ", " + folds_sql("dirty", "folded", "label") + ", " + _models_sql() + ", " + _score_sql("folded", "l_quantity", "base") + ", " + _score_sql("folded", "coalesce(l_discount, -1)", "blank")
# The candidate is the same column with its code spread over the clean levels: bucket = quantity band of the original table.
SCORES += ", clean0 AS (SELECT d.rid, d.label, fold_0, fold_1, fold_2, CASE WHEN d.l_quantity = 9999 THEN 25.5 ELSE d.l_quantity END AS q FROM folded d), " \
          + _score_sql("clean0", "CAST(floor(q / 5) AS BIGINT)", "cand")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of three versions of one table: the raw column, a band of its repaired form, another column.

    The folded table is read once: its rows are counted by all that the scores look at, and every score starts from the counts.
    """
    used = ["label", "l_quantity", "l_discount"]
    df = fixed_folds(dirty_line(spark, sf)[0].select(ROW, *used), F.col("label"), ROW)
    df = held(df.groupBy(*used, *[f"fold_{r}" for r in range(K.CV_REPEATS)]).agg(F.count("*").alias("n")))
    y = (F.col("label") == "hi").cast("int")
    args = (y, K.CV_FOLDS, K.CV_REPEATS)
    q = F.when(F.col("l_quantity") == 9999, 25.5).otherwise(F.col("l_quantity"))
    parts = {"base": F.col("l_quantity"), "cand": F.floor(q / 5), "blank": F.coalesce("l_discount", F.lit(-1.0))}
    out = None
    for k, bucket in parts.items():
        s = rate_scores(df, bucket, *args, F.col("n")).withColumn("state", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return held(out)          # one row per state and fold


ALL_STATES = " UNION ALL ".join(f"SELECT '{k}' AS state, * FROM {k}" for k in ("base", "cand", "blank"))


@query("WITH " + SCORES + f", a AS ({ALL_STATES}) SELECT state, CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold, round(-nb, 6) AS brier, n_train, n_test FROM a")
def metric_brier(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("state", "repeat", F.col("fold"), F.round(-F.col("neg_brier"), 6).alias("brier"), "n_train", "n_test")


@query("WITH " + SCORES + f", a AS ({ALL_STATES}) SELECT state, CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold, round(f1, 6) AS f1 FROM a")
def metric_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("state", "repeat", "fold", F.round("f1", 6).alias("f1"))


@query("WITH " + SCORES + f""", a AS ({ALL_STATES}) SELECT state, round(avg(nb), 6) AS mean, round(stddev_samp(nb), 6) AS std,
  round(avg(n_train), 6) AS n_train, round(avg(n_test), 6) AS n_test, count(*) AS n_folds FROM a GROUP BY 1""", name="fold_summary")
def fold_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    s = M.fold_summary(_scored(spark, sf), ["state"], "neg_brier")
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std", "n_train", "n_test")})


DELTA_SQL = f""", a AS (SELECT 'cand' AS state, * FROM cand UNION ALL SELECT 'blank', * FROM blank UNION ALL SELECT 'base', * FROM base),
  d AS (SELECT a.state, a.nb - b.nb AS d, a.n_train, a.n_test FROM a JOIN base b ON a.r = b.r AND a.f = b.f),
  e AS (SELECT state, avg(d) AS mean_delta, sqrt(var_samp(d) * (1.0 / count(*) + avg(n_test) / avg(n_train))) AS se_delta,
    count(*) - 1 AS dof FROM d GROUP BY state)"""


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    base = s.where("state = 'base'").drop("state")
    named = None
    for k in ("cand", "blank", "base"):
        d = M.paired_delta(base.withColumn("state", F.lit(k)), s.where(F.col("state") == k), ["state"], "neg_brier")
        named = d if named is None else named.unionByName(d)
    return named


@query("WITH " + SCORES + DELTA_SQL + " SELECT state, round(mean_delta, 6) AS mean_delta, round(se_delta, 6) AS se_delta, dof FROM e", name="paired_delta")
def paired_delta_query(spark: SparkSession, sf: str) -> DataFrame:
    return _deltas(spark, sf).select("state", F.round("mean_delta", 6).alias("mean_delta"), F.round("se_delta", 6).alias("se_delta"), "dof")


@query("WITH " + SCORES + DELTA_SQL + f""" SELECT state, round(mean_delta, 6) AS mean_delta, round(CAST({T15!r} AS DOUBLE) * se_delta, 6) AS bar,
  mean_delta > 0 AND mean_delta >= CAST({T15!r} AS DOUBLE) * se_delta AS clears FROM e""")
def commit_threshold(spark: SparkSession, sf: str) -> DataFrame:
    d = M.with_decision(_deltas(spark, sf), K.CV_FOLDS * K.CV_REPEATS - 1)
    return d.select("state", F.round("mean_delta", 6).alias("mean_delta"), F.round("bar", 6).alias("bar"), "clears")


@query("WITH " + SCORES + DELTA_SQL + f""" SELECT state, round(mean_delta - CAST({CI14!r} AS DOUBLE) * se_delta, 6) AS ci_low,
  round(mean_delta + CAST({CI14!r} AS DOUBLE) * se_delta, 6) AS ci_high FROM e""")
def delta_ci(spark: SparkSession, sf: str) -> DataFrame:
    d = M.with_interval(_deltas(spark, sf), K.CV_FOLDS * K.CV_REPEATS - 1)
    return d.select("state", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("WITH " + DIRTY_LINE + ", " + folds_sql("dirty", "folded", "label") + ", " + _models_sql() + ", " + LONG_FOLDS + """
  SELECT CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold, count(*) FILTER (is_test) AS n_test_raw,
  count(*) FILTER (is_test) AS n_test_committed, count(*) FILTER (NOT is_test AND l_discount IS NOT NULL) AS n_train_committed, true AS same
  FROM long GROUP BY r, f""")
def test_fold_invariant(spark: SparkSession, sf: str) -> DataFrame:
    """A committed drop_rows shrinks training rows only: test folds keep their size."""
    df = fixed_folds(dirty_line(spark, sf)[0], F.col("label"), ROW)
    state = R.fit_folds(df, {"l_discount": "drop_rows"}, training_sets(), ROW)
    rows = [F.struct(F.lit(i // 5).alias("repeat"), F.lit(i % 5).alias("fold"), F.count_if(~m).alias("n_test_raw"),
                     F.count_if(~m).alias("n_test_committed"), F.count_if(state.train[i]).alias("n_train_committed"))
            for i, m in enumerate(training_sets())]
    out = state.df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return out.withColumn("same", F.col("n_test_raw") == F.col("n_test_committed"))
