"""Detectors, repairs, leaks, the trainer and the gate on small fixtures."""
import ast
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidegate.operators import detect as D
from tidegate.operators import repair as R
from tidegate.operators.folds import fixed_folds, grouped_split, training_sets
from tidegate.operators.inject import DefectSpec, inject
from tidegate.plans.evaluate import arena, encode, evaluate, paired_gain
from tidegate.plans.gate import run_gate
from tidegate.plans.models import model_vector
from tidegate.queries.base import ROW, dirty_line, line

ROOT = Path(__file__).resolve().parent.parent / "tidegate"


@pytest.fixture(scope="module")
def ages(spark):
    rows = [(i, float(17 + (i * 7919) % 74), "ab-c" if i % 3 else "d e", "yes" if i % 4 == 0 else "no") for i in range(3000)]
    return spark.createDataFrame(rows, "rid bigint, age double, job string, y string").cache()


def found(df, defect):
    return {r["column"]: r for r in D.detect(df, "y", "rid").collect() if r["defect"] == defect}


@pytest.mark.parametrize("rate", [0.05, 0.15, 0.30])
def test_units_are_found_and_restored_without_collateral(spark, ages, rate):
    bad, key = inject(ages, [DefectSpec("u", "mixed_units", "age", rate, factor=12)], "1", "rid")
    f = found(bad, "mixed_units")
    assert f["age"]["n_rows"] == key.count() and list(f) == ["age"]
    fixed = R.finalise(bad, "rescale_units", "age")
    assert fixed.join(ages.select("rid", F.col("age").alias("t")), "rid").where("age <> t").count() == 0


def test_clean_column_is_left_alone(ages):
    assert not found(ages, "mixed_units")
    assert R.fit(ages, "rescale_units", "age") == [{"cut": None, "factor": None}]
    assert R.fit(ages, "sentinel_to_median", "age")[0]["sentinel"] is None


def test_code_is_a_sentinel_not_a_unit(ages):
    bad, _ = inject(ages, [DefectSpec("s", "sentinel", "age", 0.08, value=999.0)], "1", "rid")
    assert found(bad, "sentinel")["age"]["n_rows"] == 240 and not found(bad, "mixed_units")


def test_labels_without_ascii_letters_are_not_merged(spark):
    df = spark.createDataFrame([(i, "東京" if i % 2 else "大阪") for i in range(100)], "rid bigint, city string")
    assert D.detect_category_variants(df, ("rid",)).count() == 0
    assert R.finalise(df, "normalize_categories", "city").distinct().count() == 100


def test_repairs_are_idempotent(spark, ages):
    bad, _ = inject(ages, [DefectSpec("n", "nulls", "age", 0.1), DefectSpec("j", "category_variants", "job", 0.3)], "2", "rid")
    for op, c in (("fill_mean", "age"), ("fill_median", "age"), ("fill_mode", "job"), ("fill_unknown", "job"),
                  ("normalize_categories", "job"), ("dedupe_rows", "*"), ("drop_rows", "age")):
        once = R.finalise(bad, op, c, "rid")
        assert once.exceptAll(R.finalise(once, op, c, "rid")).count() == 0


def test_wide_spelling_table_is_joined(spark, monkeypatch, ages):
    monkeypatch.setattr(R, "INLINE_SPELLINGS", 1)
    bad, _ = inject(ages, [DefectSpec("j", "category_variants", "job", 0.3)], "2", "rid")
    params = R.fit(bad, "normalize_categories", "job")[0]
    assert "table" in params
    wide = R.apply(bad, R.Step("normalize_categories", "job", params))
    assert {r["job"] for r in wide.select("job").distinct().collect()} == {"ab-c", "d e"}


def test_wide_spelling_tables_in_folds(spark, monkeypatch, ages):
    """Joined spelling tables give every fold the values and the design that inlined ones give."""
    bad, _ = inject(ages, [DefectSpec("j", "category_variants", "job", 0.3)], "2", "rid")
    a = arena(bad, "y", "yes", "rid")
    got = []
    for most in (R.INLINE_SPELLINGS, 1):
        monkeypatch.setattr(R, "INLINE_SPELLINGS", most)
        state = R.fit_folds(a.df, {"job": "normalize_categories", "*": "dedupe_rows"}, a.models, "rid")
        assert ("table" in state.steps[0][2][0]) == (most == 1)
        seen = state.df.select("rid", F.array(*[state.value("job", m) for m in range(15)]).alias("v"), F.array(*state.train).alias("t"))
        got.append((sorted(map(tuple, seen.collect())), [x.tolist() for x in encode(a, state)[1].remap]))
    assert got[0] == got[1] and {v for _, row, _ in got[1][0] for v in row} == {"ab-c", "d e"}


def test_clip_refuses_a_flat_column(spark):
    df = spark.createDataFrame([(i, 0.0 if i else 5.0) for i in range(50)], "rid bigint, v double")
    with pytest.raises(R.RepairError):
        R.fit(df, "clip_outliers", "v")


@pytest.mark.parametrize("op,column", [("fill_mean", "job"), ("normalize_categories", "age"), ("invent", "age"), ("fill_mean", "gone")])
def test_type_guards(ages, op, column):
    with pytest.raises(R.RepairError):
        R.finalise(ages, op, column)


def test_test_rows_never_reach_a_fit(ages):
    """Changing every test value of a fold leaves that fold's parameters as they were."""
    base = fixed_folds(ages, F.col("y"), "rid").cache()
    models = training_sets()
    moved = base.withColumn("age", F.when(F.col("fold_0") == 0, 1e9).otherwise(F.col("age")))
    for op in ("fill_mean", "fill_median", "clip_outliers", "sentinel_to_median"):
        assert R.fit(base, op, "age", models)[0] == R.fit(moved, op, "age", models)[0]


def test_folds_are_stratified_and_balanced(ages):
    f = fixed_folds(ages, F.col("y"), "rid").groupBy("y", "fold_1").count().collect()
    for cls in ("yes", "no"):
        sizes = [r["count"] for r in f if r["y"] == cls]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_copies_stay_on_one_side_of_the_split(spark):
    df = spark.createDataFrame([(i, i % 40, None if i % 3 else "a", "p" if i % 2 else "q") for i in range(800)], "rid bigint, a int, b string, y string")
    g = grouped_split(df, ["a", "b"], "y", "rid", "1").groupBy("a", "b").agg(F.count_distinct("is_pilot").alias("n"))
    assert g.where("n > 1").count() == 0


def test_dedupe_in_folds_keeps_the_first_training_copy(spark):
    rows = [(i, float(i % 50), "ab"[i % 2], "yn"[(i // 50) % 2]) for i in range(300)]
    df = fixed_folds(spark.createDataFrame(rows, "rid bigint, v double, c string, y string"), F.col("y"), "rid")
    state = R.fit_folds(df, {"*": "dedupe_rows"}, training_sets(), "rid")
    got = state.df.select("rid", "v", "c", "y", "fold_0", *[F.col(f"fold_{m // 5}").alias(f"f{m}") for m in range(15)],
                          *[F.coalesce(t, F.lit(False)).alias(f"t{m}") for m, t in enumerate(state.train)]).toPandas()
    for m in range(15):
        train = got[got[f"f{m}"] != m % 5].sort_values("rid")
        assert set(train.drop_duplicates(["v", "c", "y"])["rid"]) == set(got[got[f"t{m}"]]["rid"])


def test_batched_trainer_agrees_with_spark_ml(spark, sf):
    """Same folds, same design, same penalty: the optimum is unique, so the scores agree."""
    a = arena(dirty_line(spark, sf)[0], "label", "hi", ROW, n_splits=3, n_repeats=1)
    ops = {"l_quantity": "sentinel_to_median", "l_discount": "fill_median"}
    mine = evaluate(a, ops)
    table, layout = encode(a, R.fit_folds(a.df, ops, a.models, a.row_id))
    for m in range(3):
        rows = table.select("y", F.col("train")[m].alias("side"), model_vector(layout, m).alias("raw"))
        x = np.array([r["raw"].toArray() for r in rows.where("side = 1").collect()])
        mean, std = x.mean(axis=0), x.std(axis=0)
        std[std < 1e-12] = 1.0
        scaled = F.zip_with(vector_to_array("raw"), F.array(*[F.struct(F.lit(float(a_)), F.lit(float(b_))) for a_, b_ in zip(mean, std)]),
                            lambda v, s: (v - s["col1"]) / s["col2"])
        rows = rows.select("y", "side", array_to_vector(scaled).alias("features")).cache()
        lr = LogisticRegression(labelCol="y", regParam=1.0 / len(x), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10)
        p = vector_to_array("probability")[1]
        b = lr.fit(rows.where("side = 1")).transform(rows.where("side = 0")).agg(F.avg(F.pow(p - F.col("y"), 2)).alias("b")).first()["b"]
        assert abs(-b - mine.scores[m]) < 1e-6


def test_gate_commits_the_injected_sentinel_only(spark, sf):
    a = arena(dirty_line(spark, sf)[0], "label", "hi", ROW)
    run = run_gate(a)
    assert run.committed == {"l_quantity": "sentinel_to_median"}
    assert run.final > run.baseline and len(run.iterations) <= 16
    assert run.iterations[0]["status"] == "committed" and run.iterations[0]["accepted"]
    assert {i["status"] for i in run.iterations} <= {"committed", "discarded", "error"}
    same = evaluate(a, {"l_discount": "drop_rows"})
    assert same.n_test == evaluate(a, {}).n_test and paired_gain(evaluate(a, {}), same).dof == 14


def test_deciding_code_never_sees_the_answer_key():
    for name in ("operators/detect.py", "operators/repair.py", "plans/gate.py", "plans/evaluate.py", "plans/logistic.py"):
        tree = ast.parse((ROOT / name).read_text())
        names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
        imports = {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
        assert not names & {"manifest", "expected_fix", "expected_commit"} and "tidegate.operators.inject" not in imports


def test_model_queries_do_the_whole_job(spark, sf, monkeypatch):
    """Fifteen folds and full trees for the forest gate and the single sweep; three columns with gaps for the exhaustive one."""
    import inspect
    from tidegate.plans import models
    from tidegate.queries import gating
    seen = {}
    rows = spark.createDataFrame([("event_type=none", 0.0)], "combo string, delta double")
    for name in ("single_op_sweep", "exhaustive_search"):
        monkeypatch.setattr(gating.S, name, lambda a, columns=None, name=name: seen.update({name: (a, columns)}) or rows)
    gating.single_op_sweep(spark, sf), gating.exhaustive_rank(spark, sf)
    monkeypatch.setattr(gating, "evaluate_forest", lambda a, ops: seen.update(forest=(a, ops)) or type("E", (), {"frame": lambda self, spark: rows})())
    gating.gate_rf(spark, sf)
    assert len(seen["single_op_sweep"][0].models) == len(seen["forest"][0].models) == 15
    a, columns = seen["exhaustive_search"]
    assert len(columns) == 3 and a.df.where(" OR ".join(f"{c} IS NULL" for c in columns)).count()
    assert all(a.df.where(F.col(c).isNull()).count() for c in columns)
    assert inspect.signature(models.evaluate_forest).parameters["depth"].default == 30


def test_spelling_keys_are_made_from_the_histogram(spark):
    """One key a value, not one a row: no condition on the key is pushed below the counts. Labels without a key are left out."""
    from tidegate.operators.detect import spelling_groups
    from tidegate.operators.repair import spelling_table
    df = spark.createDataFrame([("a-b",), ("A B",), ("a-b",), ("--",), ("é",), (None,)], "c string")
    for out, key in ((spelling_groups(df, ["c"]), "canonical"), (spelling_table(df, "c", [None]), "form")):
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = plan[max(i for i, x in enumerate(plan) if "Aggregate [" in x) + 1:]
        assert below and "regexp_replace" in "".join(plan) and "regexp_replace" not in "".join(below)
        assert [(r["key"], r[key]) for r in out.collect()] == [("ab", "a-b")]


def test_right_spellings_stay(spark):
    from tidegate.operators.repair import repaired
    df = spark.createDataFrame([(0, "A-b"), (1, "a b"), (2, "x"), (3, None), (4, "É"), (5, "y!")], "i int, c string")
    forms = {"ab": "A-b", "x": "y!", "é": "É"}                       # "x" becomes "y!", whose own key is another one
    got = df.select("i", repaired("normalize_categories", F.col("c"), {"forms": forms}).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["A-b", "A-b", "y!", None, "É", "y!"]


def test_preview_joins_once(spark):
    from tidegate.operators import compare as C
    before = spark.createDataFrame([(i, float(i % 5), "u") for i in range(300)] + [(7, 2.0, "twice"), (None, 1.0, "v")], "rid int, x double, t string")
    after = before.where("rid IS NULL OR rid <> 11").withColumn("x", F.when(F.col("x") == 3, 0.0).otherwise(F.col("x")))
    rows = C.preview(before, after, "rid", ["x", "t"], 5).collect()
    both = [(a, b) for a in before.collect() for b in after.collect() if a["rid"] is not None and a["rid"] == b["rid"]]
    changed = sum(a["x"] != b["x"] or a["t"] != b["t"] for a, b in both)
    assert {(r["n_changed_rows"], r["rows_dropped"]) for r in rows} == {(changed, before.count() - len(both))}
    assert [r["rid"] for r in rows] == sorted(a["rid"] for a, b in both if a["x"] != b["x"] or a["t"] != b["t"])[:5] and all(r["changed_cells"] for r in rows)
    assert C.preview(before.where("rid > 999"), after.where("rid > 999"), "rid", ["x"]).collect() == []
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x
    C.preview(before, after.withColumn("x", counted("x")), "rid", ["x"], 5).collect()
    assert seen.value <= after.count()                                                 # one job reads the join
