"""Logs scored against expectations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators.detect import detect
from tidegate.operators.repair import materialize
from tidegate.plans import expectations as X
from tidegate.plans.gate import remaining_options
from tidegate.queries.auditing import LOG, final_log
from tidegate.queries.base import DIRTY_LINE, ROW, dirty_line
from tidegate.queries.detection import LINE_DUP, LINE_NUM, LINE_TEXT, findings_sql
from tidegate.queries.registry import held, query

EXPECTED = [("line", "balance", "missing", ["drop_rows"], "no commit"), ("line", "balance", "outliers", ["clip_outliers"], "commit"),
            ("line", "segment", "inconsistency", ["normalize_categories"], "no commit"), ("line", "segment", "missing", ["fill_mode", "fill_unknown", "drop_rows"], "commit"),
            ("line", "price", "missing", ["fill_median"], "commit"), ("line", "stock", "missing", ["drop_rows"], "commit")]
EXP_SQL = "ex(\"column\", typ, ops, want) AS (VALUES " + ", ".join(f"('{c}', '{t}', {o}, '{w}')" for _, c, t, o, w in EXPECTED) + ")"
OFFERS = [("price", "fill_mean"), ("segment", "drop_rows"), ("balance", "clip_outliers"), ("balance", "sentinel_to_median"),
          ("segment", "normalize_categories"), ("price", "fill_median")]
OFF_SQL = "offer(\"column\", op) AS (VALUES " + ", ".join(f"('{c}', '{o}')" for c, o in OFFERS) + ")"
# every run was offered all pairs but "*": the sanity check must find exactly those evaluations


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPECTED, "dataset string, column string, error_type string, ops array<string>, expected string")


def offers(log: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(o).alias("operation")) for c, o in OFFERS]))
    return log.select("run").distinct().select("run", pairs.alias("p")).select("run", "p.*")


SCORED = LOG + ", " + EXP_SQL + ", " + OFF_SQL + """, steps AS (SELECT run, iteration, delta, unnest(string_split(chain_ops, ', ')) AS o, generate_subscripts(string_split(chain_ops, ', '), 1) AS pos
    FROM log WHERE status = 'committed' AND chain_ops IS NOT NULL),
  done AS (SELECT run, split_part(o, '=', 1) AS "column", split_part(arg_max(o, (iteration, pos)), '=', 2) AS op, arg_max(delta, (iteration, pos)) AS delta FROM steps GROUP BY 1, 2),
  tested AS (SELECT DISTINCT run, col AS "column", op FROM log WHERE error IS NULL),
  j AS (SELECT r.run, ex."column", typ, ops, want, EXISTS (SELECT 1 FROM done d WHERE d.run = r.run AND d."column" = ex."column" AND list_contains(ops, d.op)) AS hit,
    EXISTS (SELECT 1 FROM tested t WHERE t.run = r.run AND t."column" = ex."column" AND list_contains(ops, t.op)) AS tst,
    EXISTS (SELECT 1 FROM log l WHERE l.run = r.run AND l.col = ex."column" AND error IS NOT NULL) AS failed,
    EXISTS (SELECT 1 FROM offer o WHERE o."column" = ex."column" AND list_contains(ops, o.op)) AS off FROM (SELECT DISTINCT run FROM log) r, ex),
  score AS (SELECT run, "column", typ AS error_type, want AS expected, CASE WHEN want = 'commit' AND hit THEN 'hit' WHEN want = 'commit' THEN 'miss' WHEN hit THEN 'commit-on-no-commit-row'
    ELSE 'correct no-commit' END AS obs, CASE WHEN want = 'commit' AND NOT hit THEN CASE WHEN tst THEN 'gate-reject' WHEN failed THEN 'unclassified (error)' WHEN off THEN 'planner-miss'
    ELSE 'detector-miss' END END AS stage FROM j)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    log = held(final_log(spark, sf))
    return X.score_stage(expected(spark), log, offers(log))


@query("WITH " + SCORED + ' SELECT run, "column", op AS operation, delta FROM done')
def committed_from_log(spark: SparkSession, sf: str) -> DataFrame:
    return X.committed_from_log(final_log(spark, sf))


@query("WITH " + SCORED + " SELECT * FROM score")
def score_stage(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


@query("WITH " + SCORED + """ SELECT d.run, d."column", d.op AS operation, CASE WHEN coalesce(e.want = 'commit' AND list_contains(e.ops, d.op), false) THEN 'hit-commit'
    WHEN NOT EXISTS (SELECT 1 FROM ex x WHERE x."column" = d."column" AND x.want = 'commit') THEN 'unexplained: no error expected on the column'
    WHEN coalesce(e.want = 'commit', false) THEN 'unexplained: operation not reachable' ELSE 'wrong-op' END AS class
  FROM done d LEFT JOIN ex e ON e."column" = d."column" AND e.typ = CASE WHEN d.op IN ('fill_mean', 'fill_median', 'fill_mode', 'fill_unknown', 'drop_rows') THEN 'missing'
    WHEN d.op = 'clip_outliers' THEN 'outliers' WHEN d.op = 'normalize_categories' THEN 'inconsistency' END""")
def score_commit_class(spark: SparkSession, sf: str) -> DataFrame:
    return X.commit_class(expected(spark), X.committed_from_log(final_log(spark, sf)))


@query("WITH " + SCORED + ' SELECT run, "column", op AS operation FROM tested t WHERE NOT EXISTS (SELECT 1 FROM offer o WHERE o."column" = t."column" AND o.op = t.op)')
def offers_sanity(spark: SparkSession, sf: str) -> DataFrame:
    log = held(final_log(spark, sf))
    return X.missing_offers(log, offers(log))


STATES = ({}, {"l_quantity": "sentinel_to_median"})
CTES_0, FINDINGS_0 = findings_sql("dirty", LINE_NUM, LINE_TEXT, LINE_DUP, "a")
CTES_1, FINDINGS_1 = findings_sql("after", LINE_NUM, LINE_TEXT, LINE_DUP, "b")


@query("WITH " + DIRTY_LINE + """, after AS (SELECT rid, CASE WHEN l_quantity = 9999 THEN (SELECT median(l_quantity) FROM dirty WHERE l_quantity <> 9999) ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, label FROM dirty), """ + CTES_0 + ", " + CTES_1 + f""", o AS (SELECT 0 AS state, "column", unnest(string_split(ops, ',')) AS operation
    FROM ({FINDINGS_0}) UNION ALL SELECT 1, "column", unnest(string_split(ops, ',')) FROM ({FINDINGS_1}))
  SELECT DISTINCT state, "column", operation FROM o WHERE operation <> ''""")
def offers_reconstructed(spark: SparkSession, sf: str) -> DataFrame:
    """What the detectors offer in every committed state a log went through."""
    raw = dirty_line(spark, sf)[0]
    out = None
    for i, ops in enumerate(STATES):
        part = remaining_options(detect(materialize(raw, ops, ROW), "label", ROW)).select(F.lit(i).alias("state"), "column", "operation")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH " + LOG + """, f AS (SELECT run, planner, arg_min(error, iteration) FILTER (error IS NOT NULL) AS e FROM log GROUP BY 1, 2)
  SELECT run, planner, CASE WHEN planner = 'rule' OR e IS NULL THEN 'valid' WHEN starts_with(e, 'Error code:') THEN 'invalid: infrastructure failure'
    ELSE 'terminated: menu constraint violated' END AS status FROM f""")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return X.run_status(final_log(spark, sf))


@query("WITH " + SCORED + """ SELECT run, count(*) FILTER (obs = 'hit') AS h2_hits, count(*) FILTER (expected = 'commit') AS h2_n, count(*) FILTER (obs = 'correct no-commit') AS h1_correct,
  count(*) FILTER (expected <> 'commit') AS h1_n, count(*) FILTER (stage = 'gate-reject') AS gate_reject, count(*) FILTER (stage = 'planner-miss') AS planner_miss,
  count(*) FILTER (stage = 'detector-miss') AS detector_miss, count(*) FILTER (stage = 'unclassified (error)') AS unclassified FROM score GROUP BY 1""")
def score_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.score_counts(_scores(spark, sf))


@query("WITH " + SCORED + """, s AS (SELECT run, string_agg("column" || '|' || error_type || '|' || obs || '|' || coalesce(stage, '-'), ';' ORDER BY "column" || '|' || error_type) AS sig FROM score GROUP BY 1)
  SELECT run // 3 AS "group", count(*) AS runs, count(DISTINCT sig) = 1 AS identical FROM s GROUP BY 1""")
def replicate_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs in a row are replicates."""
    return X.replicate_signature(_scores(spark, sf), F.floor(F.col("run") / 3).cast("bigint"))


@query("WITH " + LOG + """ SELECT run, arg_max(col, (delta, -iteration)) AS "column", arg_max(op, (delta, -iteration)) AS operation, max(delta) AS delta,
  arg_max(threshold, (delta, -iteration)) AS threshold, count(*) FILTER (delta > 0) AS n_positive, count(*) AS n_evaluated FROM log WHERE error IS NULL GROUP BY 1""")
def largest_delta(spark: SparkSession, sf: str) -> DataFrame:
    return X.largest_delta(final_log(spark, sf))


@query("WITH " + LOG + """ SELECT run, CASE WHEN contains(path, '/market') THEN 'market' WHEN contains(path, '/lodging') THEN 'lodging' WHEN contains(path, '/tmp/') THEN 'temporary file'
  ELSE 'unidentified' END AS dataset, count(*) AS iterations, CASE WHEN count(delta) = 0 THEN 'nothing evaluated' WHEN bool_or(status = 'committed') THEN 'committed' ELSE 'all discarded' END AS outcome
  FROM log GROUP BY run, path""")
def run_listing(spark: SparkSession, sf: str) -> DataFrame:
    return X.run_listing(final_log(spark, sf), {"/market": "market", "/lodging": "lodging", "/tmp/": "temporary file"})
