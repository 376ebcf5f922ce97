"""Detectors on damaged tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators import detect as D
from tidegate.queries.base import DIRTY_EVENTS, DIRTY_LINE, DIRTY_ORDERS, ROW, dirty_events, dirty_line, dirty_orders
from tidegate.queries.registry import query
from tidegate.sources.tables import table

LINE_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_TEXT = ("l_returnflag",)


def flat(findings: DataFrame) -> DataFrame:
    return findings.select("defect", "column", "n_rows", "pct", "evidence", F.array_join("candidate_ops", ",").alias("ops"))


def pct_sql(n: str, rows: str) -> str:
    return f"round_even(CAST(100 * {n} AS DOUBLE) / {rows}, 3)"


def missing_sql(src: str, num: tuple, text: tuple) -> str:
    def one(c, ops):
        return (f"SELECT 'missing' AS defect, '{c}' AS \"column\", count(*) - count({c}) AS n_rows, count(*) AS t, '{ops}' AS ops FROM {src}")
    parts = [one(c, "fill_median,fill_mean,drop_rows") for c in num] + [one(c, "fill_mode,fill_unknown,drop_rows") for c in text]
    p = pct_sql("n_rows", "t")
    return (f"SELECT defect, \"column\", n_rows, {p} AS pct, n_rows || ' gaps in ' || CAST({p} AS VARCHAR) || '% of rows' "
            f"AS evidence, ops FROM ({' UNION ALL '.join(parts)}) WHERE n_rows > 0")


def duplicates_sql(src: str, cols: tuple) -> str:
    return (f"SELECT 'duplicates' AS defect, '*' AS \"column\", n AS n_rows, {pct_sql('n', 't')} AS pct, "
            f"n || ' rows repeat a row that came before' AS evidence, 'dedupe_rows' AS ops FROM "
            f"(SELECT CAST(sum(k - 1) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS t FROM "
            f"(SELECT count(*) AS k FROM {src} GROUP BY {', '.join(cols)})) WHERE n > 0")


MAGIC = "(regexp_full_match(CAST(CAST(floor(abs(v)) AS BIGINT) AS VARCHAR), '9{2,}') OR v IN (-1, -9, -99, -999, -9999))"


def ends_ctes(src: str, num: tuple, p: str) -> str:
    hist = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 2"
                              for c in num)
    def end(name, order):
        return (f"SELECT c, '{name}' AS e, max(v) FILTER (rn = 1) AS v, max(n) FILTER (rn = 1) AS n, max(v) FILTER (rn = 2) AS near, "
                f"median(n) FILTER (rn > 1) AS med FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v {order}) AS rn FROM {p}_h) "
                f"WHERE rn <= 11 GROUP BY c")
    return (f"{p}_h AS ({hist}), {p}_f AS (SELECT c, count(*) AS nd, sum(n) AS nv FROM {p}_h GROUP BY c), "
            f"{p}_e AS (SELECT x.*, nd, nv FROM ({end('max', 'DESC')} UNION ALL {end('min', 'ASC')}) x JOIN {p}_f USING (c))")


def spikes_ctes(src: str, num: tuple, p: str) -> str:
    iqr = " UNION ALL ".join(f"SELECT '{c}' AS c, quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) AS clip FROM {src}" for c in num)
    return ends_ctes(src, num, p) + f""", {p}_q AS ({iqr}), {p}_s AS (
      SELECT *, n / greatest(coalesce(med, 1), 1) AS ratio, {pct_sql('n', f'(SELECT count(*) FROM {src})')} AS pct,
        {MAGIC} AND coalesce(abs(v - near) > 0.5 * greatest(abs(near), 1), false) AS sent FROM {p}_e),
      {p}_t AS (SELECT *, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS shown
        FROM {p}_s JOIN {p}_q USING (c) WHERE nd >= 12 AND n >= 20 AND pct >= 0.05
        AND n <= CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM {src}) AND (sent OR ratio >= 5))"""


def spikes_sql(p: str) -> str:
    return (f"SELECT CASE WHEN sent THEN 'sentinel' ELSE 'top_coded' END AS defect, c AS \"column\", n AS n_rows, pct, "
            f"'value ' || shown || ' appears ' || n || 'x (' || CAST(pct AS VARCHAR) || '% of rows), ' || CAST(round_even(ratio, 0) AS BIGINT) "
            f"|| ' times as often as values near it' || CASE WHEN sent THEN ', far from all others: a code for no value' "
            f"ELSE ', at an end: values may have been cut there' END AS evidence, concat_ws(',', CASE WHEN sent THEN 'sentinel_to_median' END, "
            f"CASE WHEN clip THEN 'clip_outliers' END) AS ops FROM {p}_t")


def variants_ctes(src: str, text: tuple, p: str) -> str:
    hist = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 2" for c in text)
    return (f"{p}_vh AS (SELECT *, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS k FROM ({hist})), "
            f"{p}_vk AS (SELECT c, k, count(*) AS forms, sum(n) AS n, max(n) AS top, arg_min(v, (-n, v)) AS canon FROM {p}_vh "
            f"WHERE k <> '' GROUP BY c, k)")


def variants_sql(src: str, p: str) -> str:
    return (f"SELECT 'category_variants' AS defect, c AS \"column\", n AS n_rows, {pct_sql('n', f'(SELECT count(*) FROM {src})')} AS pct, "
            f"keys || ' levels in ' || forms || ' spellings; ' || n || ' rows have a rarer one' AS evidence, "
            f"'normalize_categories' AS ops FROM (SELECT c, count(*) AS keys, CAST(sum(forms) AS BIGINT) AS forms, "
            f"CAST(sum(n - top) AS BIGINT) AS n FROM {p}_vk WHERE forms > 1 GROUP BY c)")


def units_ctes(src: str, num: tuple, p: str) -> str:
    """<p>_u(c, cut, factor): consecutive distinct values, straight from the definition."""
    raw = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM {src} WHERE {c} > 0" for c in num)
    return f"""{p}_ur AS ({raw}), {p}_ud AS (SELECT c, v, lag(v) OVER (PARTITION BY c ORDER BY v) AS pv FROM (SELECT DISTINCT c, v FROM {p}_ur)),
      {p}_ug AS (SELECT c, arg_min(pv, (-(v / pv), v)) AS low, arg_min(v, (-(v / pv), v)) AS high FROM {p}_ud WHERE v / pv >= 1.5 GROUP BY c),
      {p}_uf AS (SELECT c, low, high, count(*) AS n, count(DISTINCT v) AS nd, count(*) FILTER (v >= high) AS nh,
        count(DISTINCT v) FILTER (v >= high) AS ndh, median(v) FILTER (v <= low) AS ml, median(v) FILTER (v >= high) AS mh,
        min(v) AS lmin, max(v) AS hmax FROM {p}_ur JOIN {p}_ug USING (c) GROUP BY ALL),
      {p}_uk AS (SELECT *, mh / ml AS r, CASE WHEN abs(mh / ml - 12) / 12 <= abs(mh / ml - 100) / 100
          AND abs(mh / ml - 12) / 12 <= abs(mh / ml - 1000) / 1000 THEN 12
        WHEN abs(mh / ml - 100) / 100 <= abs(mh / ml - 1000) / 1000 THEN 100 ELSE 1000 END AS f FROM {p}_uf),
      {p}_u AS (SELECT c, low * 1.5 AS cut, f AS factor FROM {p}_uk WHERE n >= 200 AND nd >= 12 AND nh >= 20 AND ndh >= 5
        AND nh / n BETWEEN 0.01 AND 0.5 AND abs(r - f) / f <= 0.25 AND high / f >= 0.9 * lmin AND hmax / f <= 1.1 * low)"""


def units_sql(src: str, p: str) -> str:
    return (f"SELECT 'mixed_units' AS defect, c AS \"column\", n AS n_rows, {pct_sql('n', f'(SELECT count(*) FROM {src})')} AS pct, "
            f"n || ' values lie beyond ' || CAST(round_even(cut, 0) AS BIGINT) || ', where a gap begins; divided by ' || "
            f"factor || ' they fall among the others: two units' AS evidence, 'rescale_units' AS ops FROM "
            f"(SELECT c, cut, factor, count(*) FILTER (v > cut) AS n FROM {p}_ur JOIN {p}_u USING (c) GROUP BY ALL)")


def findings_sql(src: str, num: tuple, text: tuple, dup: tuple, p: str) -> tuple[str, str]:
    """(CTEs, findings SELECT) of all detectors."""
    ctes = ", ".join([spikes_ctes(src, num, p), variants_ctes(src, text, p), units_ctes(src, num, p)])
    body = " UNION ALL ".join([missing_sql(src, num, text), duplicates_sql(src, dup), spikes_sql(p), variants_sql(src, p), units_sql(src, p)])
    return ctes, body


LINE_DUP = LINE_NUM + LINE_TEXT + ("label",)
LINE_CTES, LINE_FINDINGS = findings_sql("dirty", LINE_NUM, LINE_TEXT, LINE_DUP, "d")


@query("WITH " + DIRTY_ORDERS + " " + missing_sql("dord", ("o_custkey", "o_totalprice"), ("o_orderpriority", "o_orderstatus")))
def detect_missing(spark: SparkSession, sf: str) -> DataFrame:
    return flat(D.detect_missing(dirty_orders(spark, sf)[0], (ROW,)))


@query(duplicates_sql("documents", ("text", "lang", "n_chars")))
def detect_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return flat(D.detect_duplicates(table(spark, sf, "documents"), ("doc_id", "source")))


@query("WITH " + DIRTY_LINE + ", " + spikes_ctes("dirty", LINE_NUM, "d") + ", " + DIRTY_EVENTS + ", "
       + spikes_ctes("dev", ("user_id", "value"), "e") + " " + spikes_sql("d") + " UNION ALL " + spikes_sql("e"))
def detect_spikes(spark: SparkSession, sf: str) -> DataFrame:
    """A code far outside the range (sentinel) and a cap just above it (top-coded)."""
    return flat(D.detect_spikes(dirty_line(spark, sf)[0], (ROW, "label"))).unionByName(
        flat(D.detect_spikes(dirty_events(spark, sf)[0], (ROW,))))


@query("WITH " + DIRTY_LINE + ", " + ends_ctes("dirty", LINE_NUM, "d") + f""", s AS (SELECT c, e, v, nd >= 12 AND n >= 20 AND n / nv <= 0.2
    AND {MAGIC} AND coalesce(abs(v - near) > 0.5 * greatest(abs(near), 1), false) AS ok FROM d_e)
  SELECT c AS "column", coalesce(max(v) FILTER (e = 'max' AND ok), max(v) FILTER (e = 'min' AND ok)) AS sentinel FROM s GROUP BY c""")
def fit_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return D.fit_sentinels(dirty_line(spark, sf)[0], list(LINE_NUM))


@query("WITH " + DIRTY_ORDERS + ", " + variants_ctes("dord", ("o_orderpriority", "o_orderstatus"), "v") + " " + variants_sql("dord", "v"))
def detect_category_variants(spark: SparkSession, sf: str) -> DataFrame:
    return flat(D.detect_category_variants(dirty_orders(spark, sf)[0], (ROW,)))


@query("WITH " + DIRTY_LINE + ", " + units_ctes("dirty", LINE_NUM, "d") + " " + units_sql("dirty", "d"))
def detect_mixed_units(spark: SparkSession, sf: str) -> DataFrame:
    return flat(D.detect_mixed_units(dirty_line(spark, sf)[0], (ROW, "label")))


@query("WITH " + DIRTY_LINE + ", " + LINE_CTES + " " + LINE_FINDINGS)
def detect_all(spark: SparkSession, sf: str) -> DataFrame:
    return flat(D.detect(dirty_line(spark, sf)[0], "label", ROW))
