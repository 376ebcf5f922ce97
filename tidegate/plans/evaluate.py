"""Scoring a set of repairs on fixed folds: the measurement behind every commit.

Every fold starts from the raw rows. The repairs are fitted on its training rows only and
applied to both sides; row operations shrink the training side only, so test rows never change.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace


import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegate import constants as K
from tidegate.functions.quantiles import Ask, exact_quantiles
from tidegate.functions.stats import clears, commit_bar
from tidegate.functions.text import norm_key
from tidegate.operators.folds import fixed_folds, training_sets
from tidegate.operators.histogram import training_histogram, value_histogram
from tidegate.operators.repair import FoldFit, fit_folds, known_forms
from tidegate.plans.logistic import FoldScores, Layout, fit_and_score

SCORE_SCHEMA = "repeat int, fold int, neg_brier double, f1 double, n_train bigint, n_test bigint"


class EvaluationError(ValueError):
    """The table cannot be encoded for the gate model."""


@dataclass
class Evaluation:
    scores: list[float]                # the gate score, negative Brier: higher is better
    f1_scores: list[float]
    n_train: list[int]
    n_test: list[int]
    n_splits: int
    weights: np.ndarray | None = None

    @property
    def mean(self) -> float:
        return float(np.mean(self.scores))

    @property
    def std(self) -> float:
        return float(np.std(self.scores, ddof=1))

    @property
    def f1(self) -> float:
        return float(np.mean(self.f1_scores))

    def frame(self, spark) -> DataFrame:
        rows = [(i // self.n_splits, i % self.n_splits, float(s), float(f), int(a), int(b))
                for i, (s, f, a, b) in enumerate(zip(self.scores, self.f1_scores, self.n_train, self.n_test))]
        return spark.createDataFrame(rows, SCORE_SCHEMA)


@dataclass(frozen=True)
class Gain:
    delta: float
    se: float
    dof: int
    bar: float

    @property
    def clears(self) -> bool:
        return clears(self.delta, self.bar)


def paired_gain(base: Evaluation, cand: Evaluation, looks: int = K.MAX_ITERATIONS) -> Gain:
    """Scalar twin of operators.metrics.paired_delta for the driver-side loop over fifteen scores."""
    d = np.array(cand.scores) - np.array(base.scores)
    n = len(d)
    ratio = np.mean(cand.n_test) / np.mean(cand.n_train)
    se = float(np.sqrt(d.var(ddof=1) * (1 / n + ratio))) if n > 1 else 0.0
    return Gain(float(d.mean()), se, n - 1, commit_bar(se, n - 1, looks))


@dataclass
class Arena:
    """A raw table with its fixed folds and the column facts every evaluation needs."""
    df: DataFrame
    row_id: str
    target: str
    n_splits: int
    n_repeats: int
    numeric: list[str]
    text: list[str]
    nullable: set[str]
    levels: dict[str, list[tuple[str, str | None]]]
    bounds: dict[str, int]
    fits: dict = field(default_factory=dict)
    medians: dict = field(default_factory=dict)
    cache: dict = field(default_factory=dict)
    last: np.ndarray | None = None
    conditions: list[Column] | None = None       # training sets other than the fixed folds

    @property
    def models(self) -> list[Column]:
        return self.conditions or training_sets(self.n_splits, self.n_repeats)

    def with_constant(self, column: str, value) -> "Arena":
        """The same rows and folds with one column destroyed."""
        text = column in self.text
        return replace(self, df=self.df.withColumn(column, F.lit(value).cast(self.df.schema[column].dataType)),
                       nullable=self.nullable - {column}, cache={}, fits={}, medians={},
                       levels={**self.levels, **({column: [(value, value)]} if text else {})})

    def release(self) -> None:
        self.df.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core for the CPU-bound passes; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def arena(df: DataFrame, target: str, positive: str, row_id: str, n_splits: int = K.CV_FOLDS,
          n_repeats: int = K.CV_REPEATS, seed: str = str(K.RANDOM_STATE)) -> Arena:
    """Draw the folds once and keep the table; one pass finds nulls and text levels."""
    y = (F.trim(F.col(target).cast("string")) == F.lit(positive)).cast("int")
    keep = fixed_folds(df.withColumn("_y", y), F.col("_y"), row_id, seed, n_splits, n_repeats)
    drawn = keep.persist(StorageLevel.MEMORY_AND_DISK)       # kept before its partitions are counted: counting runs the shuffles
    keep = spread(drawn)
    if keep is not drawn:
        keep = keep.persist(StorageLevel.MEMORY_AND_DISK)
    feats = [f for f in df.schema.fields if f.name not in (row_id, target)]
    numeric = [f.name for f in feats if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in feats if isinstance(f.dataType, T.StringType)]
    facts = keep.agg(F.count("*").alias("_n"), *[e for c in numeric for e in (
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}"), F.approx_count_distinct(f"`{c}`").alias(f"size_{c}"))]).first()
    if keep is not drawn:
        drawn.unpersist()
    levels: dict[str, list] = {c: [] for c in text}
    if text:
        hist = value_histogram(keep, text, "string")
        sizes = {r["column"]: r["n"] for r in hist.groupBy("column").agg(F.count("*").alias("n")).collect()}
        wide = {c: n for c, n in sizes.items() if n > K.MAX_ONEHOT_LEVELS}
        if wide:
            raise EvaluationError(f"too many text levels to one-hot encode (limit {K.MAX_ONEHOT_LEVELS}): {wide}")
        for r in hist.select("column", "value", norm_key(F.col("value")).alias("key")).orderBy("column", "value").collect():
            levels[r["column"]].append((r["value"], r["key"]))          # at most 300 levels per column
    return Arena(keep, row_id, target, n_splits, n_repeats, numeric, text,
                 {c for c in numeric if facts[f"null_{c}"]}, levels,
                 {c: int(1.2 * facts[f"size_{c}"]) + 16 for c in numeric})


def encode(a: Arena, state: FoldFit, cap: dict[str, int] | None = None, scale_levels: bool = True,
           merge: bool = False) -> tuple[DataFrame, Layout]:
    """Design table of one candidate: values a model sees differently are laid out per model.

    ``cap``: text columns whose rare training levels (and levels unseen in training) share a slot.
    ``merge``: a column whose fits came out the same for every model is laid out once; this moves columns,
    which a linear model does not notice.
    """
    touched = {c for op, c, _ in state.steps if op not in K.ROW_OPS}
    k = len(state.train)
    own = [c for c in a.numeric if c in touched or c in a.nullable]
    medians = {c: _train_medians(a, state, c) for c in own if c in a.nullable}
    if merge:
        fits = [(c, params) for _, c, params in state.steps] + list(medians.items())
        own = [c for c in own if any(f != each[0] for col, each in fits if col == c for f in each)]
    shared = [c for c in a.numeric if c not in own]

    def seen(c: str, m: int) -> Column:
        v = state.value(c, m).cast("double")
        return F.coalesce(v, F.lit(medians[c][m])) if c in medians else v

    codes, remaps, sizes = [], [], []
    for c in a.text:
        values = [v for v, _ in a.levels[c]]
        unknown, null = len(values), len(values) + 1
        where = {v: i for i, v in enumerate(values)}
        lookup = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
        codes.append(F.coalesce(F.array_position(lookup, F.col(f"`{c}`")) - 1, F.lit(null)).cast("int"))
        table = np.tile(np.arange(null + 1), (k, 1))
        for op, col, params in state.steps:
            if col != c:
                continue
            for m in range(k):
                if op == "fill_mode":
                    table[m, null] = where[params[m]["value"]]
                elif op == "fill_unknown":
                    table[m, null] = where.get(K.UNKNOWN_LABEL, unknown)
                elif op == "normalize_categories":
                    forms = known_forms(params[m], [key for _, key in a.levels[c] if key is not None])
                    for i, (_, key) in enumerate(a.levels[c]):
                        form = forms.get(key)
                        table[m, i] = where[form] if form is not None else i
        if cap and c in cap:
            _pool_rare(state, c, values, table, unknown, cap[c])
        remaps.append(table)
        sizes.append(null + 1)
    base = a.models
    side = F.array(*[F.when(state.train[m], 1).when(base[m], -1).otherwise(0).cast("tinyint") for m in range(k)])
    out = [F.col("_y").alias("y"), F.col(a.row_id).alias("rid"), side.alias("train")]
    if shared:
        out.append(F.array(*[seen(c, 0) for c in shared]).alias("x"))
    if own:
        out.append(F.array(*[seen(c, m) for m in range(k) for c in own]).alias("z"))
    if codes:
        out.append(F.array(*codes).alias("c"))
    return state.df.select(*out), Layout(k, len(shared), len(own), tuple(sizes), tuple(remaps), scale_levels)


def _pool_rare(state: FoldFit, c: str, values: list[str], table: np.ndarray, slot: int, cap: int) -> None:
    """Per model with more than ``cap`` training levels: all but the cap - 1 most frequent go to ``slot``."""
    counts = np.zeros(table.shape, dtype=int)
    where = {v: i for i, v in enumerate(values)}
    for r in training_histogram(state.df, F.col(f"`{c}`"), state.train).collect():      # at most 300 levels per model
        counts[r["column"], where[r["value"]]] = r["n"]
    for m in range(len(table)):
        seen = [i for i in np.argsort(-counts[m], kind="stable") if counts[m, i]]
        if len(seen) > cap:
            keep = set(seen[:cap - 1])
            for i in range(len(values)):
                if i not in keep:
                    table[m, i] = slot


def _train_medians(a: Arena, state: FoldFit, c: str) -> list[float]:
    """What fills the numeric gaps a repair leaves: the training median, 0 for an empty column."""
    key = (c, tuple(op for op, col, _ in state.steps if col == c and op not in K.ROW_OPS), state.rows_key)
    if key not in a.medians:
        k = len(state.train)
        q = exact_quantiles(state.df, [Ask(str(m), state.value(c, m), (0.5,), state.train[m]) for m in range(k)],
                            bound=a.bounds[c])
        a.medians[key] = [float(q[str(m)][0]) if q[str(m)] else 0.0 for m in range(k)]
    return a.medians[key]


def evaluate(a: Arena, ops: dict[str, str]) -> Evaluation:
    """Score the table after ``ops``; the same set of ops is only ever evaluated once."""
    key = tuple(ops.items())
    if key in a.cache:
        return a.cache[key]
    state = fit_folds(a.df, ops, a.models, a.row_id, a.fits, a.bounds)
    table, layout = encode(a, state, merge=True)
    if "*" in ops:
        table = spread(table)                    # the join on kept copies may have merged partitions
    s: FoldScores = fit_and_score(table, layout, a.last)
    a.last = s.weights
    a.cache[key] = Evaluation(list(s.neg_brier), list(s.f1), list(s.n_train.astype(int)), list(s.n_test.astype(int)),
                              a.n_splits, s.weights)
    return a.cache[key]


#: What the batched linear comparison applies by itself; any other step goes through fitted chains.
BATCHED = {"imputation": {"mean": "fill_mean", "median": "fill_median", "most_frequent": "fill_mode"},
           "encoding": ("onehot", "onehot_capped"), "scaling": ("standard",)}


def compare_preprocessing(a: Arena, recommended: list[dict], family: str = "linear") -> dict:
    """Recommended against default preprocessing on the fixed folds: paired gain and scores.

    ``recommended``: rows of (stage, method, columns). The default fills medians and most frequent
    levels, one-hot encodes and standardises. Every step is applied inside every fold, or raises.
    """
    from tidegate.plans import fitted
    fitted.plan_of(recommended, a.df.schema)                   # raises for a step that does not exist or does not suit
    if fitted.class_weighted(recommended):
        raise EvaluationError("a comparison by probabilities applies no class weights")
    scaled = {c for s in recommended if s["stage"] == "scaling" for c in s["columns"]}
    batched = family == "linear" and scaled == set(a.numeric) and all(s["method"] in BATCHED.get(s["stage"], ()) for s in recommended)
    out = _compare_batched(a, recommended) if batched else [
        score_chains(a, steps, family) for steps in (fitted.default_steps(a.numeric, a.text), recommended)]
    gain = paired_gain(out[0], out[1])
    swap = lambda e: Evaluation(e.f1_scores, e.f1_scores, e.n_train, e.n_test, e.n_splits)
    f1_gain = paired_gain(swap(out[0]), swap(out[1]))
    return {"default_mean": out[0].mean, "recommended_mean": out[1].mean, "mean_diff": gain.delta, "se_corrected": gain.se,
            "f1_default_mean": out[0].f1, "f1_recommended_mean": out[1].f1, "f1_mean_diff": f1_gain.delta, "f1_se_corrected": f1_gain.se,
            "n_folds": len(out[0].scores)}


def _compare_batched(a: Arena, recommended: list[dict]) -> list[Evaluation]:
    ops, cap = {}, {}
    for s in recommended:
        for c in s["columns"]:
            if s["stage"] == "imputation":
                ops[c] = BATCHED["imputation"][s["method"]]
            elif s["method"] == "onehot_capped":
                cap[c] = K.HIGH_CARD
    text_gaps = [r[0] for r in a.df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in a.text]).unpivot(
        [], a.text, "c", "n").where("n > 0").collect()] if a.text else []
    default = {**{c: "fill_median" for c in sorted(a.nullable)}, **{c: "fill_mode" for c in text_gaps}}
    out = []
    for plan_ops, plan_cap in ((default, None), (ops, cap)):
        state = fit_folds(a.df, plan_ops, a.models, a.row_id, a.fits, a.bounds)
        table, layout = encode(a, state, plan_cap, scale_levels=False, merge=True)
        out.append(_scored(table, layout, a.n_splits))
    return out


def _scored(table: DataFrame, layout: Layout, n_splits: int) -> Evaluation:
    s = fit_and_score(table, layout)
    return Evaluation(list(s.neg_brier), list(s.f1), list(s.n_train.astype(int)), list(s.n_test.astype(int)), n_splits)


def score_chains(a: Arena, steps: list[dict], family: str) -> Evaluation:
    """A family's score on all folds with ``steps`` fitted inside each: the linear and the tree family for all
    folds in one job, neighbours and perceptrons fold by fold."""
    from tidegate.plans import fitted, forest, models
    chains = fitted.fit_chains(a.df, fitted.plan_of(steps, a.df.schema), a.models)
    k, width = len(chains), max(sum(c.size for c in m) for m in chains)

    def padded(m: int) -> Column:                               # folds may have learned different levels
        return F.concat(fitted.features(chains[m]), F.array_repeat(F.lit(0.0), width - sum(c.size for c in chains[m])))
    side = F.array(*[F.when(t, 1).otherwise(0).cast("tinyint") for t in a.models])
    if family == "linear":
        table = a.df.select(F.col("_y").alias("y"), F.col(a.row_id).alias("rid"), side.alias("train"), F.concat(*[padded(m) for m in range(k)]).alias("z"))
        return _scored(table, Layout(k, 0, width, (), (), scale_numbers=False), a.n_splits)
    if family == "tree_ensemble":
        rows = forest.long_rows(a.df.withColumn("y", F.col("_y")), k, lambda m: F.when(a.models[m], 1).otherwise(0), padded, a.row_id)
        return models.score_forest(rows, k, forest.ForestSpec(), a.n_splits)
    return models.score_each(a, [padded(m) for m in range(k)], width, family)
