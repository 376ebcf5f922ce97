"""Audit analytics. The log is derived from the orders table: ten orders make one run."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from tidegate.plans import audit as A
from tidegate.plans import study as S
from tidegate.queries.registry import held, query
from tidegate.session import scratch_path
from tidegate.sources import audit_log
from tidegate.sources.tables import table

# Which column and operation an order stands for, by the first letter of its priority.
PAIRS = {"1": ("balance", "sentinel_to_median"), "2": ("balance", "clip_outliers"), "3": ("segment", "normalize_categories"),
         "4": ("price", "fill_median"), "5": ("*", "dedupe_rows")}


def raw_log(spark: SparkSession, sf: str) -> DataFrame:
    """Iterations as logged, chains still staged."""
    o = table(spark, sf, "orders")
    k, cents, p = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint"), F.substring("o_orderpriority", 1, 1)
    pick = lambda i: F.create_map(*[F.lit(x) for key, v in PAIRS.items() for x in (key, v[i])])[p]
    run = F.floor(k / 10).cast("bigint")
    failed = cents % 17 == 0
    before = F.round(F.lit(-0.1) - (run % 50) / F.lit(1000.0), 4)
    delta = F.round((cents % 401 - 250) / F.lit(10000.0), 4)
    base = o.select(
        run.alias("run"), (k % 10 + 1).cast("int").alias("iteration"), pick(0).alias("column"), pick(1).alias("operation"),
        F.concat(F.lit("rule: "), (cents % 50).cast("string"), F.lit(" rows")).alias("reason"), before.alias("f1_before"),
        F.when(~failed, F.round(before + delta, 4)).alias("f1_after"), F.when(~failed, delta).alias("delta"),
        F.when(~failed, 0.01).alias("std_before"), F.when(~failed, 0.012).alias("std_after"),
        F.when(~failed, F.round((cents % 23 + 1) / F.lit(10000.0), 4)).alias("se"),
        F.when(~failed, F.round((cents % 23 + 1) * 3 / F.lit(10000.0), 4)).alias("threshold"), F.lit(False).alias("accepted"),
        F.when(failed & (cents % 2 == 0), "Error code: 500").when(failed, "clipping refused").alias("error"),
        F.when(failed, "error").when((F.col("o_orderstatus") == "P") | ((delta > 0) & (delta >= F.round((cents % 23 + 1) * 3 / F.lit(10000.0), 4))), "staged")
        .otherwise("discarded").alias("status"), F.floor((k % 10) / 4).cast("int").alias("chain_id"),
        F.when(run % 3 == 0, "rule").otherwise("model").alias("planner"), F.lit("line").alias("dataset"),
        F.element_at(F.array(*[F.lit(x) for x in ("/data/real/market.csv", "/data/real/lodging.csv", "/tmp/g.csv", "/x.csv")]), (run % 4 + 1).cast("int")).alias("path"))
    w = W.partitionBy("run", "chain_id").orderBy("iteration")     # at most four rows
    ops = F.collect_list(F.when(F.col("status") == "staged", F.struct("column", "operation"))).over(w)
    return base.withColumn("chain_ops", ops).withColumn("committed_ops", F.array().cast("array<struct<column:string,operation:string>>"))


def chain_outcomes(log: DataFrame) -> DataFrame:
    """A chain with a cleared bar commits; one run in five ends before its other chains resolve."""
    won = F.bool_or((F.col("status") == "staged") & (F.col("delta") > 0) & (F.col("delta") >= F.col("threshold")))
    return log.groupBy("run", "chain_id").agg(won.alias("won")).select(
        "run", "chain_id", F.when(F.col("won"), "committed").when(F.col("run") % 5 != 0, "discarded").alias("outcome"))


def final_log(spark: SparkSession, sf: str) -> DataFrame:
    log = raw_log(spark, sf)
    return A.resolve_chains(log, chain_outcomes(log))


BAR = "round((cents % 23 + 1) * 3 / CAST(10000 AS DOUBLE), 4)"
DELTA = "round((cents % 401 - 250) / CAST(10000 AS DOUBLE), 4)"
RAW = f"""au0 AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey // 10 AS run FROM orders),
au1 AS (SELECT run, CAST(o_orderkey % 10 + 1 AS INTEGER) AS iteration, {' '.join(['CASE substr(o_orderpriority, 1, 1)'] + [f"WHEN '{k}' THEN '{v[0]}'" for k, v in PAIRS.items()])} END AS col,
  {' '.join(['CASE substr(o_orderpriority, 1, 1)'] + [f"WHEN '{k}' THEN '{v[1]}'" for k, v in PAIRS.items()])} END AS op, 'rule: ' || (cents % 50) || ' rows' AS reason,
  round(-0.1 - (run % 50) / CAST(1000 AS DOUBLE), 4) AS f1_before, CASE WHEN cents % 17 <> 0 THEN {DELTA} END AS delta,
  CASE WHEN cents % 17 <> 0 THEN round((cents % 23 + 1) / CAST(10000 AS DOUBLE), 4) END AS se, CASE WHEN cents % 17 <> 0 THEN {BAR} END AS threshold,
  CASE WHEN cents % 34 = 0 THEN 'Error code: 500' WHEN cents % 17 = 0 THEN 'clipping refused' END AS error,
  CASE WHEN cents % 17 = 0 THEN 'error' WHEN o_orderstatus = 'P' OR ({DELTA} > 0 AND {DELTA} >= {BAR}) THEN 'staged' ELSE 'discarded' END AS status,
  CAST((o_orderkey % 10) // 4 AS INTEGER) AS chain_id, CASE WHEN run % 3 = 0 THEN 'rule' ELSE 'model' END AS planner,
  (['/data/real/market.csv', '/data/real/lodging.csv', '/tmp/g.csv', '/x.csv'])[run % 4 + 1] AS path FROM au0),
raw_log AS (SELECT *, round(f1_before + delta, 4) AS f1_after,
  string_agg(CASE WHEN status = 'staged' THEN col || '=' || op END, ', ') OVER (PARTITION BY run, chain_id ORDER BY iteration) AS chain_ops,
  count(*) FILTER (status = 'staged') OVER (PARTITION BY run, chain_id ORDER BY iteration) AS n_ops FROM au1)"""
LOG = RAW + """, outc AS (SELECT run, chain_id, CASE WHEN bool_or(status = 'staged' AND delta > 0 AND delta >= threshold) THEN 'committed'
    WHEN run % 5 <> 0 THEN 'discarded' END AS outcome FROM raw_log GROUP BY 1, 2),
log AS (SELECT raw_log.* EXCLUDE (status), CASE WHEN status = 'staged' AND outcome IS NOT NULL THEN outcome ELSE status END AS status,
  coalesce(status = 'staged' AND outcome = 'committed', false) AS accepted FROM raw_log JOIN outc USING (run, chain_id))"""
FACTS = LOG + """, fact AS (SELECT *, coalesce(delta >= threshold, false) AS own_clears, CASE WHEN threshold > 0 THEN delta / threshold END AS ratio,
  CASE WHEN se > 0 THEN delta / se END AS z FROM log),
chain AS (SELECT run, chain_id, CASE WHEN bool_or(status = 'committed') THEN 'committed' WHEN count(delta) > 0 AND bool_or(status = 'staged') THEN 'unresolved'
    WHEN count(delta) > 0 THEN 'discarded' ELSE 'no_evaluation' END AS chain_status, arg_max(chain_ops, iteration) FILTER (chain_ops IS NOT NULL) AS ops,
  CASE WHEN bool_or(status = 'committed') THEN max(iteration) FILTER (delta IS NOT NULL AND own_clears) END AS commit_iter FROM fact GROUP BY 1, 2)"""
ZT = "coalesce(', ' || CAST(round_even(z, 1) AS VARCHAR) || ' SE', '')"
S4, P4 = "printf('%+.4f', delta)", "printf('%.4f', threshold)"
VERDICT = FACTS + f""", v0 AS (SELECT fact.*, commit_iter, CASE WHEN delta IS NULL THEN 'no_eval' WHEN status = 'committed' AND own_clears THEN 'commit'
    WHEN status = 'committed' THEN 'commit_with_chain' WHEN status = 'staged' THEN 'unresolved' WHEN delta <= 0 THEN 'rollback' ELSE 'noise' END AS code
  FROM fact JOIN chain USING (run, chain_id)),
verdict AS (SELECT *, CASE code WHEN 'no_eval' THEN 'Unmeasured: ' || coalesce(error, 'no result') WHEN 'commit' THEN 'Kept: gain ' || {S4} || ' against a required ' || {P4} || {ZT}
  WHEN 'commit_with_chain' THEN 'Kept as part of a chain: its own gain ' || {S4} || ' fell short of ' || {P4} || ', which the chain passed in step ' || coalesce(CAST(commit_iter AS VARCHAR), 'None')
  WHEN 'unresolved' THEN 'Open at the end of the run: gain ' || {S4} || ', required ' || {P4}
  WHEN 'rollback' THEN 'Undone: gain ' || {S4} || ', so scores did not rise (required ' || {P4} || ')'
  ELSE 'Undone: gain ' || {S4} || ' reaches ' || CAST(round_even(100 * ratio, 0) AS BIGINT) || '% of the required ' || {P4} || {ZT} || ', which chance explains' END AS text FROM v0)"""
SUMMARY = FACTS + """, s1 AS (SELECT run, arg_min(f1_before, iteration) AS baseline, arg_max(f1_after, iteration) FILTER (status = 'committed' AND own_clears) AS last,
    count(ratio) FILTER (delta IS NOT NULL) AS n_evaluations, arg_max(iteration, (ratio, -iteration)) FILTER (ratio IS NOT NULL) AS close_it,
    arg_max(ratio, (ratio, -iteration)) FILTER (ratio IS NOT NULL) AS close_ratio, arg_max(delta, (ratio, -iteration)) FILTER (ratio IS NOT NULL) AS close_delta,
    arg_max(threshold, (ratio, -iteration)) FILTER (ratio IS NOT NULL) AS close_bar FROM fact GROUP BY 1),
  s2 AS (SELECT run, count(*) FILTER (chain_status = 'committed') AS n_committed, count(*) FILTER (chain_status <> 'no_evaluation') AS n_chains FROM chain GROUP BY 1),
  s3 AS (SELECT run, chain_id, unnest(string_split(ops, ', ')) AS o, generate_subscripts(string_split(ops, ', '), 1) AS pos FROM chain WHERE chain_status = 'committed' AND ops IS NOT NULL),
  s4 AS (SELECT run, split_part(o, '=', 1) AS c, arg_max(o, (chain_id, pos)) AS o FROM s3 GROUP BY 1, 2),
  s5 AS (SELECT run, string_agg(o, ', ' ORDER BY o) AS committed_ops FROM s4 GROUP BY 1),
  summary AS (SELECT run, baseline, coalesce(last, baseline) AS final, n_evaluations, n_chains, n_committed, coalesce(committed_ops, '(none)') AS committed_ops,
    close_it, close_ratio, close_delta, close_bar FROM s1 JOIN s2 USING (run) LEFT JOIN s5 USING (run))"""


def _facts(spark, sf):
    f = held(A.facts(final_log(spark, sf)))
    return f, A.chains(f)


@query("WITH " + LOG + " SELECT run, iteration, col AS \"column\", op AS operation, f1_before, f1_after, delta, threshold, status, accepted, error, chain_id, coalesce(chain_ops, '') AS ops FROM log")
def audit_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write the log as JSON, read it back."""
    log = final_log(spark, sf)
    path = scratch_path(spark, "audit")
    audit_log.write_log(log, path)
    back = audit_log.read_log(spark, [path], log.schema)
    return back.select("run", "iteration", "column", "operation", "f1_before", "f1_after", "delta", "threshold", "status", "accepted", "error",
                       "chain_id", A.ops_text(F.col("chain_ops")).alias("ops"))


@query("WITH " + LOG + " SELECT run, iteration, chain_id, status, accepted FROM log")
def resolve_chain(spark: SparkSession, sf: str) -> DataFrame:
    return final_log(spark, sf).select("run", "iteration", "chain_id", "status", "accepted")


@query("WITH " + RAW + """, t AS (SELECT run, iteration, delta, threshold, coalesce(max(delta) FILTER (status = 'staged') OVER (PARTITION BY run, chain_id ORDER BY iteration
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain_delta FROM raw_log WHERE delta IS NOT NULL)
  SELECT *, CASE WHEN delta > 0 AND delta >= threshold THEN 'commit' WHEN delta > chain_delta + 0.25 * greatest(threshold, 0) THEN 'stage' ELSE 'drop' END AS decision FROM t""")
def stage_decisions(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("run", "chain_id").orderBy("iteration").rowsBetween(W.unboundedPreceding, -1)
    t = raw_log(spark, sf).where("delta IS NOT NULL").select("run", "iteration", "delta", "threshold", F.coalesce(
        F.max(F.when(F.col("status") == "staged", F.col("delta"))).over(w), F.lit(0.0)).alias("chain_delta"))
    return A.stage_decisions(t)


@query("""WITH d AS (SELECT DISTINCT l_returnflag || '=' || l_linestatus AS combo FROM lineitem), a AS (SELECT DISTINCT f.l_returnflag || '=' || s.l_linestatus AS combo,
    s.l_linestatus FROM (SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT DISTINCT l_linestatus FROM lineitem UNION ALL SELECT 'new') s)
  SELECT combo FROM a WHERE combo NOT IN (SELECT combo FROM d)""")
def sweep_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations a resumed sweep still has to do: the grid of options minus what is in the table."""
    li = table(spark, sf, "lineitem")
    done = li.select(F.concat("l_returnflag", F.lit("="), "l_linestatus").alias("combo")).distinct()
    states = li.agg(F.array_append(F.collect_set("l_linestatus"), "new").alias("s")).first()["s"]      # a handful of states
    grid = li.select("l_returnflag").distinct().select(
        "l_returnflag", F.explode(F.array(*map(F.lit, states))).alias("s")).select(F.concat("l_returnflag", F.lit("="), "s").alias("combo"))
    return S.unfinished(grid, done)


@query("WITH " + FACTS + " SELECT run, iteration, own_clears, round(ratio, 6) AS ratio, round(z, 6) AS z FROM fact")
def audit_facts(spark: SparkSession, sf: str) -> DataFrame:
    return A.facts(final_log(spark, sf)).select("run", "iteration", "own_clears", F.round("ratio", 6).alias("ratio"), F.round("z", 6).alias("z"))


@query("WITH " + FACTS + " SELECT run, chain_id, chain_status, ops, commit_iter FROM chain")
def audit_chains(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf)[1].withColumn("ops", A.ops_text(F.col("ops")))


@query("WITH " + VERDICT + " SELECT run, iteration, code, text FROM verdict")
def audit_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return A.verdicts(*_facts(spark, sf)).select("run", "iteration", "code", "text")


@query("WITH " + SUMMARY + """ SELECT run, baseline, final, n_evaluations, n_chains, n_committed, committed_ops, close_it AS closest_iteration,
  round(close_ratio, 6) AS closest_ratio FROM summary""")
def audit_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.run_summary(*_facts(spark, sf)).select(
        "run", "baseline", "final", "n_evaluations", "n_chains", "n_committed", "committed_ops", F.col("closest.iteration").alias("closest_iteration"),
        F.round("closest.ratio", 6).alias("closest_ratio"))


@query("WITH " + SUMMARY + """ SELECT run, CASE WHEN n_committed = 0 THEN n_chains || ' chains and ' || n_evaluations || ' measurements, none of them enough; the table stays as it is. neg-Brier '
    || printf('%.4f', baseline) || ' -> ' || printf('%.4f', final) || ' as before.' || CASE WHEN close_ratio > 0 THEN ' Nearest: step ' || close_it || ' at '
    || CAST(round_even(100 * close_ratio, 0) AS BIGINT) || '% of what it needed (gain ' || printf('%+.4f', close_delta) || ', required ' || printf('%.4f', close_bar) || ').' ELSE '' END
  ELSE n_committed || ' of ' || n_chains || ' chains kept (' || committed_ops || '). neg-Brier ' || printf('%.4f', baseline) || ' -> ' || printf('%.4f', final)
    || ' (' || printf('%+.4f', final - baseline) || ').' END AS headline FROM summary""")
def audit_headline(spark: SparkSession, sf: str) -> DataFrame:
    return A.headline(A.run_summary(*_facts(spark, sf)))


def _case(key: str, table: dict[str, str], other: str, sub: bool = False) -> str:
    value = lambda v: "replace('{}', '{{c}}', col)".format(v) if sub else "'" + v + "'"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + f" ELSE {other} END"


FIX = _case("op", A.PLAIN_FIX, "'Cleaned ' || col", True)
PLAIN = VERDICT + ", s1 AS" + SUMMARY.split(", s1 AS", 1)[1] + """, p AS (SELECT run, count(*) AS tried, count(*) FILTER (chain_status = 'committed') AS kept,
    count(*) FILTER (status = 'discarded') AS rolled_back FROM verdict JOIN chain USING (run, chain_id) GROUP BY 1)"""


@query("WITH " + PLAIN + """ SELECT run, tried, kept, rolled_back, 'Tried ' || tried || ' repair' || CASE WHEN tried = 1 THEN '' ELSE 's' END || ': '
    || CASE WHEN kept = 0 THEN 'none stayed, as no gain was certain.' ELSE kept || CASE WHEN kept = 1 THEN ' has' ELSE ' have' END || ' stayed'
    || CASE WHEN tried > kept THEN ', the others were taken back.' ELSE '.' END END AS head,
  CASE WHEN kept = 0 OR final = baseline THEN 'The table is the one that came in.' WHEN final > baseline THEN
    'Held-out predictions got better, which speaks for the repairs but does not prove them.'
    ELSE 'Scores did not rise.' END AS overall FROM p JOIN summary USING (run)""")
def audit_plain(spark: SparkSession, sf: str) -> DataFrame:
    f, c = _facts(spark, sf)
    return A.plain_summary(f, c, A.run_summary(f, c))


@query("WITH " + VERDICT + f""" SELECT run, iteration, col AS "column", op AS operation, delta, code, text, {FIX} AS plain_fix,
  CASE WHEN code IN ('commit', 'commit_with_chain') THEN CASE WHEN ratio IS NULL THEN 'predictions got better by an unknown amount'
    WHEN ratio >= 3 THEN 'predictions got clearly better' ELSE 'predictions got a little better' END
  ELSE {_case('code', A.UNDONE_REASON, "'" + A.UNDONE_OTHER + "'")} END AS why FROM verdict""")
def audit_repairs(spark: SparkSession, sf: str) -> DataFrame:
    v = A.verdicts(*_facts(spark, sf))
    why = F.when(F.col("code").isin("commit", "commit_with_chain"), A.impact(F.col("ratio"))).otherwise(A.undone_reason(F.col("code")))
    return v.select("run", "iteration", "column", "operation", "delta", "code", "text", A.plain_fix(F.col("column"), F.col("operation")).alias("plain_fix"),
                    why.alias("why"))


NOTE = """CASE (run + iteration) % 5 WHEN 0 THEN 'Delta ' || coalesce(printf('%+.4f', delta), 'unknown') || ' for ' || op || ' at iteration ' || iteration
  WHEN 1 THEN 'Delta was 0.4321 here' WHEN 2 THEN 'This is about fill_mode only' WHEN 3 THEN 'The result contradicts the plan' ELSE 'Tested 77 rows' END"""


@query("WITH " + VERDICT + f""", n AS (SELECT *, {NOTE} AS note FROM verdict)
  SELECT run, iteration, note, CASE (run + iteration) % 5 WHEN 1 THEN 'number 0.4321 not in log' WHEN 2 THEN CASE WHEN op = 'fill_mode' THEN '' ELSE 'operation fill_mode not tested here' END
    WHEN 3 THEN '''contradicts'' is not allowed' WHEN 4 THEN 'number 77 not in log' ELSE '' END AS problems FROM n""")
def guard_notes(spark: SparkSession, sf: str) -> DataFrame:
    f, c = _facts(spark, sf)
    k = (F.col("run") + F.col("iteration")) % 5
    note = (F.when(k == 0, F.concat(F.lit("Delta "), F.when(F.col("delta").isNull(), "unknown").otherwise(A.signed(F.col("delta"))), F.lit(" for "),
                                    F.col("operation"), F.lit(" at iteration "), F.col("iteration").cast("string")))
            .when(k == 1, "Delta was 0.4321 here").when(k == 2, "This is about fill_mode only").when(k == 3, "The result contradicts the plan").otherwise("Tested 77 rows"))
    judged = A.with_allowed(A.verdicts(f, c).withColumn("note", note), A.run_summary(f, c))
    return A.note_problems(judged).select("run", "iteration", "note", F.array_join("problems", "; ").alias("problems"))
