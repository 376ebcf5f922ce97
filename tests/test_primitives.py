"""Quantiles, seeded order, t quantile: against brute force."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions.hashing import Draw, draw_cuts, in_draw, prefix_digits, ranked_in_class
from tidegate.functions import hashing
from tidegate.functions.quantiles import Ask, exact_quantiles
from tidegate.functions.stats import clears, commit_bar, t_quantile


@pytest.mark.parametrize("limit", [10, 1500, 10**6])
def test_quantiles_match_numpy_on_every_path(spark, limit):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [9999.0] * 700 + [rng.random() * 1e7 for _ in range(300)] + [-5.0]
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "v double, g int").repartition(5)
    asks = [Ask("all", F.col("v"), (0.0, 0.25, 0.5, 0.9, 1.0)), Ask("part", F.col("v"), (0.5,), F.col("g") != 1),
            Ask("none", F.col("v"), (0.5,), F.col("g") > 5)]
    got = exact_quantiles(df, asks, limit=limit)
    assert got["none"] is None
    assert np.allclose(got["all"], np.quantile(values, (0.0, 0.25, 0.5, 0.9, 1.0)))
    assert np.allclose(got["part"], np.quantile([v for i, v in enumerate(values) if i % 3 != 1], 0.5))


@pytest.mark.parametrize("group_rows", [4096, 4])
def test_draw_is_the_head_of_the_hash_order(spark, monkeypatch, group_rows):
    monkeypatch.setattr(hashing, "GROUP_ROWS", group_rows)
    ids = list(range(1000))
    df = spark.createDataFrame([(i, i % 4 == 0) for i in ids], "rid bigint, odd boolean")
    draws = [Draw("a", "s", 0.137), Draw("b", "t", 0.5, F.col("odd")), Draw("zero", "u", 0.0)]
    cuts = draw_cuts(df, "rid", draws)
    order = lambda seed, xs: sorted(xs, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    want = {"a": set(order("s", ids)[:137]), "b": set(order("t", [i for i in ids if i % 4 == 0])[:125]), "zero": set()}
    for d in draws:
        got = {r["rid"] for r in df.where(in_draw(d, cuts[d.name], "rid")).collect()}
        assert got == want[d.name]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_ranks_are_a_permutation_of_each_class(spark, digits):
    df = spark.createDataFrame([(i, "x" if i % 5 else None) for i in range(2000)], "rid bigint, c string")
    rows = ranked_in_class(df, F.col("c"), "rid", "9", 2, digits).collect()
    for cls, n in (("x", 1600), (None, 400)):
        for r in ("rank_0", "rank_1"):
            assert sorted(x[r] for x in rows if x["c"] == cls) == list(range(n))


def test_prefix_digits_keep_groups_small():
    assert prefix_digits(1000) == 0 and prefix_digits(10**6) == 1 and prefix_digits(10**12) == 6


def test_t_quantile_and_commit_rule():
    assert abs(t_quantile(1 - 0.05 / 16, 14) - 3.2135) < 1e-3
    assert abs(t_quantile(0.975, 14) - 2.1448) < 1e-3
    assert commit_bar(1.0, 0) == math.inf
    assert not clears(0.0, 0.0) and clears(0.1, 0.1) and not clears(0.1, 0.2)


@pytest.mark.parametrize("limit", [100, 200_000])
@pytest.mark.parametrize("case", ["two clusters", "nan", "inf", "constant", "wide"])
def test_quantiles_end_and_agree_at_every_limit(spark, case, limit):
    v = np.random.default_rng(3).random(8000)
    v = {"two clusters": np.concatenate([v[:4000] / 2, v[4000:] / 2 + 1e6]), "nan": np.concatenate([v, [np.nan] * 5]), "inf": np.concatenate([v, [np.inf] * 5]),
         "constant": np.full(8000, 2.0), "wide": np.concatenate([v, [1e300, -1e300, -np.inf]])}[case]
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    got = exact_quantiles(df, [Ask("q", F.col("x"), (0.25, 0.5, 0.75))], limit)["q"]
    assert np.allclose(got, np.quantile(v[~np.isnan(v)], [0.25, 0.5, 0.75]), rtol=1e-12)


def test_group_key_has_no_collisions(spark):
    from tidegate.operators.folds import group_key
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("<NA>", "x"), ("-", "x"), ("1:a", None), ("1", "a"), ("", "1:a")]
    assert spark.createDataFrame(rows, "x string, y string").select(group_key(["x", "y"])).distinct().count() == len(rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_and_medians_meet_values_without_a_shuffle(spark):
    """A local table has no known size; without a hint all values were sorted and shuffled to a handful of keys."""
    from tidegate.functions.quantiles import _in_range, _long, _Target
    from tidegate.operators.encode import scaled
    df = spark.range(100).select(F.col("id").cast("double").alias("v"), F.lit(0).alias("model"))
    near = _in_range(_long(df, [Ask("q", F.col("v"))]), [(0, 0, _Target(3, 0.0, 50.0, 0, 51))], {0: (0.0, 99.0)})
    moments = spark.createDataFrame([(0, "v", 100, 49.5, 28.9)], "model int, column string, n bigint, mean double, std double")
    for d, rows in ((near, 51), (scaled(df, moments, "v"), 100)):
        assert "SortMergeJoin" not in _plan(d) and d.count() == rows


@pytest.mark.parametrize("group_rows", [4096, 4])
def test_only_the_last_prefix_of_a_draw_leaves_the_scan(spark, monkeypatch, group_rows):
    """Null ids are in no draw's order, null conditions are not eligible; the rows are ranked after a filter, not after a join."""
    monkeypatch.setattr(hashing, "GROUP_ROWS", group_rows)
    rows = [(i, None if i % 7 == 0 else i % 2 == 0) for i in range(700)]
    df = spark.createDataFrame(rows, "rid bigint, ok boolean")
    plans = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(_plan(self)) or collect(self))
    cut = draw_cuts(df, "rid", [Draw("a", "s", 0.2, F.col("ok"))])["a"]
    monkeypatch.undo()
    order = sorted((hashlib.md5(f"s:{i}".encode()).hexdigest(), i) for i, ok in rows if ok)
    assert cut.eligible == len(order) and cut.rows == round(0.2 * len(order)) and (cut.hash, cut.row_id) == order[cut.rows - 1]
    assert "Join" not in plans[-1]


def test_scores_of_counted_rows_are_the_scores_of_the_rows(spark):
    from tidegate.plans.rate_table import rate_scores
    df = spark.createDataFrame([(i % 4 if i % 9 else None, int(i % 3 == 0), i % 5, (i // 5) % 5) for i in range(600)],
                               "b int, y int, fold_0 int, fold_1 int")
    counted = df.groupBy("b", "y", "fold_0", "fold_1").agg(F.count("*").alias("k"))
    key = lambda d: sorted((r["repeat"], r["fold"], round(r["neg_brier"], 9), round(r["f1"], 9), r["n_train"], r["n_test"]) for r in d.collect())
    assert key(rate_scores(counted, F.col("b"), F.col("y"), 5, 2, F.col("k"))) == key(rate_scores(df, F.col("b"), F.col("y"), 5, 2))


def test_folded_rows_are_read_once_for_all_scores(spark, sf, monkeypatch):
    from tidegate.queries import evaluation
    read = []
    monkeypatch.setattr(evaluation, "rate_scores", lambda df, *a, _f=evaluation.rate_scores: read.append(df.columns) or _f(df, *a))
    assert evaluation._scored(spark, sf).count() == 45
    assert len(read) == 3 and all("rid" not in c and "n" in c for c in read)
