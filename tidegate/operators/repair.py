"""The repair menu: fit on training rows, apply to any rows.

A fit is a handful of scalars (or a spelling table). It is computed for a list of *models* at
once, a model being the row condition of one training set, so the fifteen training folds cost
one pass instead of fifteen. The same column expression applies a fit to a batch table, to
held-out rows and to a stream.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegate import constants as K
from tidegate.functions.quantiles import Ask, exact_quantiles
from tidegate.functions.text import norm_key
from tidegate.operators.detect import confirm_units, sentinels, unit_candidates
from tidegate.operators.histogram import in_models, training_histogram

INLINE_SPELLINGS = 2000        # beyond this a spelling table is joined, not written into the plan

Models = list[Column | None]


class RepairError(ValueError):
    """The repair does not fit the column or has nothing to fit on."""


def check_op(op: str, dtype: T.DataType | None, column: str) -> None:
    if op not in K.OPERATION_MENU:
        raise RepairError(f"unknown operation {op}")
    if op == "dedupe_rows":
        return
    if dtype is None:
        raise RepairError(f"unknown column {column}")
    numeric = isinstance(dtype, T.NumericType)
    if op in K.NUMERIC_ONLY_OPS and not numeric:
        raise RepairError(f"{op} needs a numeric column, {column} is {dtype.simpleString()}")
    if op in K.TEXT_ONLY_OPS and numeric:
        raise RepairError(f"{op} needs a text column, {column} is {dtype.simpleString()}")


def _dtype(df: DataFrame, column: str) -> T.DataType | None:
    return df.schema[column].dataType if column in df.columns else None


# ---------------------------------------------------------------- fitting

def fit(df: DataFrame, op: str, column: str, models: Models = (None,), bound: int | None = None) -> list[dict]:
    """One parameter dict per model. ``bound``: known upper bound on the column's distinct values."""
    check_op(op, _dtype(df, column), column)
    c = F.col(f"`{column}`")
    models = list(models)
    ids = range(len(models))
    if op == "fill_mean":
        rows = df.select(c.alias("v"), F.explode(in_models(models)).alias("m")).groupBy("m").agg(F.avg("v").alias("a")).collect()
        means = {r["m"]: r["a"] for r in rows}
        return [{"value": means.get(i)} for i in ids]
    if op == "fill_median":
        q = exact_quantiles(df, [Ask(str(i), c, (0.5,), m) for i, m in enumerate(models)], bound=bound)
        return [{"value": q[str(i)][0] if q[str(i)] else None} for i in ids]
    if op == "fill_mode":
        return _fit_mode(df, column, models)
    if op == "clip_outliers":
        return _fit_clip(df, column, models, bound)
    if op == "sentinel_to_median":
        return _fit_sentinel(df, column, models, bound)
    if op == "rescale_units":
        return _fit_units(df, column, models, bound)
    if op == "normalize_categories":
        return _fit_spellings(df, column, models)
    return [{} for _ in ids]                         # fill_unknown, drop_rows, dedupe_rows


def _fit_mode(df: DataFrame, column: str, models: Models) -> list[dict]:
    hist = training_histogram(df, F.col(f"`{column}`"), models)
    modes = {r["column"]: r["v"] for r in hist.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v")).collect()}
    if len(modes) < len(models):
        raise RepairError(f"no value of {column} in a training set, there is no mode")
    return [{"value": modes[i]} for i in range(len(models))]


def _fit_clip(df: DataFrame, column: str, models: Models, bound: int | None) -> list[dict]:
    q = exact_quantiles(df, [Ask(str(i), F.col(f"`{column}`"), (0.25, 0.75), m) for i, m in enumerate(models)], bound=bound)
    out = []
    for i in range(len(models)):
        if q[str(i)] is None:
            raise RepairError(f"no value of {column} in a training set, there is nothing to clip by")
        q1, q3 = q[str(i)]
        if q3 == q1:
            raise RepairError(f"clipping refused on {column}: the interquartile range is 0")
        width = K.IQR_FENCE * (q3 - q1)
        out.append({"low": q1 - width, "high": q3 + width})
    return out


def _fit_sentinel(df: DataFrame, column: str, models: Models, bound: int | None) -> list[dict]:
    c = F.col(f"`{column}`").cast("double")
    rows = sentinels(training_histogram(df, c, models)).collect()
    found = {r["column"]: r["sentinel"] for r in rows if r["sentinel"] is not None}
    q = exact_quantiles(df, [Ask(str(i), c, (0.5,), (c != sv) if models[i] is None else models[i] & (c != sv))
                             for i, sv in found.items()], bound=bound)
    return [{"sentinel": found.get(i), "median": q[str(i)][0] if i in found else None} for i in range(len(models))]


def _fit_units(df: DataFrame, column: str, models: Models, bound: int | None) -> list[dict]:
    c = F.col(f"`{column}`").cast("double")
    facts = unit_candidates(training_histogram(df, c, models))
    found = confirm_units(df, facts, lambda i: c, lambda i: models[i], bound)
    return [dict(zip(("cut", "factor"), found.get(i, (None, None)))) for i in range(len(models))]


def spelling_table(df: DataFrame, column: str, models: Models) -> DataFrame:
    """(column, key, form): the most frequent training spelling of every key, per model."""
    hist = training_histogram(df, F.col(f"`{column}`").cast("string"), models).withColumn("key", norm_key(F.col("value")))
    # a condition on the key itself would be pushed below the histogram, and every row would make its key
    return hist.groupBy("column", "key").agg(F.count("key").alias("keyed"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("form")).where("keyed > 0").drop("keyed")


def _fit_spellings(df: DataFrame, column: str, models: Models) -> list[dict]:
    table = spelling_table(df, column, models)
    most = INLINE_SPELLINGS * len(models)
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        from tidegate.session import written
        kept = written(table, f"spellings-{column}")
        return [{"table": kept.where(F.col("column") == i).select("key", "form")} for i in range(len(models))]
    out: list[dict] = [{} for _ in models]
    for r in rows:
        out[r["column"]][r["key"]] = r["form"]
    return [{"forms": f} for f in out]


def known_forms(params: dict, keys: list[str]) -> dict[str, str]:
    """The forms of ``keys``, which are few enough for the driver."""
    if "forms" in params:
        return params["forms"]
    return {r["key"]: r["form"] for r in params["table"].where(F.col("key").isin(keys)).collect()}


# ---------------------------------------------------------------- applying

def repaired(op: str, c: Column, params: dict) -> Column:
    """The repaired value of one cell. Row operations and joined spelling tables are handled by ``apply``."""
    if op in ("fill_mean", "fill_median"):
        return F.coalesce(c.cast("double"), F.lit(params["value"]).cast("double"))
    if op == "fill_mode":
        return F.coalesce(c, F.lit(params["value"]))
    if op == "fill_unknown":
        return F.coalesce(c.cast("string"), F.lit(K.UNKNOWN_LABEL))
    if op == "clip_outliers":
        d = c.cast("double")
        return F.when(d < params["low"], params["low"]).when(d > params["high"], params["high"]).otherwise(d)
    if op == "sentinel_to_median":
        if params["sentinel"] is None:
            return c
        return F.when(c == params["sentinel"], F.lit(params["median"]).cast("double")).otherwise(c.cast("double"))
    if op == "rescale_units":
        if params["cut"] is None:
            return c
        return F.when(c > params["cut"], c / F.lit(params["factor"])).otherwise(c.cast("double"))
    if op == "normalize_categories":
        forms = params["forms"]
        if not forms:
            return c
        table = F.create_map(*[F.lit(x) for kv in sorted(forms.items()) for x in kv])
        right = sorted(v for k, v in forms.items() if v.isascii() and re.sub(K.NORM_KEY_PATTERN, "", v.lower()) == k)      # these stay as they are
        other = F.coalesce(F.element_at(table, norm_key(c)), c)
        return F.when(c.isin(right), c).otherwise(other) if right else other
    return c


def first_copies(df: DataFrame, row_id: str | None) -> DataFrame:
    """One row per group of copies, the one with the smallest row id. An aggregation, not a window:
    copies are combined before the shuffle, so one huge group of copies stays cheap."""
    cols = [c for c in df.columns if c != row_id]
    if row_id is None:
        return df.distinct()
    return df.groupBy(*cols).agg(F.min(row_id).alias(row_id)).select(*df.columns)


@dataclass(frozen=True)
class Step:
    """A fitted repair."""
    op: str
    column: str
    params: dict = field(default_factory=dict)


def apply(df: DataFrame, step: Step, row_id: str | None = None) -> DataFrame:
    check_op(step.op, _dtype(df, step.column), step.column)
    if step.op == "drop_rows":
        return df.where(F.col(f"`{step.column}`").isNotNull())
    if step.op == "dedupe_rows":
        return first_copies(df, row_id)
    if "table" in step.params:
        # Spark picks broadcast or a shuffled join from the table's size; AQE splits hot spellings
        forms = step.params["table"].select(F.col("key").alias("_key"), F.col("form").alias("_form"))
        joined = df.withColumn("_k", norm_key(F.col(step.column))).join(forms, F.col("_k") == F.col("_key"), "left")
        return joined.withColumn(step.column, F.coalesce("_form", step.column)).select(*df.columns)
    return df.withColumn(step.column, repaired(step.op, F.col(f"`{step.column}`"), step.params))


def finalise(df: DataFrame, op: str, column: str, row_id: str | None = None) -> DataFrame:
    """Fit on all rows and apply to all rows: for decisions already taken, never for scoring."""
    return apply(df, Step(op, column, fit(df, op, column)[0]), row_id)


def materialize(df: DataFrame, ops: dict[str, str], row_id: str | None = None) -> DataFrame:
    """Apply every committed operation in order."""
    for column, op in ops.items():
        df = finalise(df, op, column, row_id)
    return df


def fit_recipe(df: DataFrame, ops: dict[str, str], row_id: str | None = None) -> tuple[DataFrame, list[dict]]:
    """(cleaned table, recipe). Every step is fitted on the result of the steps before it."""
    recipe = []
    for column, op in ops.items():
        step = Step(op, column, fit(df, op, column)[0])
        before = df
        df = apply(df, step, row_id)
        removed = before.count() - df.count() if op in K.ROW_OPS else 0
        recipe.append({"op": op, "column": column, "params": step.params, "rows_removed": removed})
    return df, recipe


def replay_recipe(df: DataFrame, recipe: list[dict], row_id: str | None = None) -> DataFrame:
    """Apply saved parameters without refitting; works on streams for all steps but dedupe_rows."""
    for r in recipe:
        df = apply(df, Step(r["op"], r["column"], r["params"]), row_id)
    return df


# ---------------------------------------------------------------- fold-local replay

@dataclass
class FoldFit:
    """All operations of one candidate, fitted on every training fold."""
    df: DataFrame
    train: list[Column]
    steps: list[tuple[str, str, list[dict]]]
    rows_key: tuple = ()                  # which row operations shaped the training rows

    def value(self, column: str, model: int) -> Column:
        """The column as model ``model`` sees it."""
        c = F.col(f"`{column}`")
        for j, (op, col, params) in enumerate(self.steps):
            if col == column and op not in K.ROW_OPS:
                joined = "table" in params[model]
                c = F.coalesce(F.element_at(f"_forms{j}", F.lit(model)), c) if joined else repaired(op, c, params[model])
        return c


def fit_folds(df: DataFrame, ops: dict[str, str], models: Models, row_id: str,
              fits: dict | None = None, bounds: dict[str, int] | None = None) -> FoldFit:
    """Replay ``ops`` in order on every training fold. Row operations shrink training rows only.

    An operation on one column is fitted on the raw column, so its fit only depends on the row
    operations before it; ``fits`` keeps fits between calls under that key.
    """
    state = FoldFit(df, list(models), [])
    before: tuple = ()
    for column, op in ops.items():
        check_op(op, _dtype(state.df, column), column)
        if op == "drop_rows":
            state.train = [m & F.col(f"`{column}`").isNotNull() for m in state.train]
        elif op == "dedupe_rows":
            _keep_first_copies(state, row_id)
        key = (op, column, before)
        if fits is None or key not in fits:
            params = fit(state.df, op, column, state.train, (bounds or {}).get(column))
            if fits is not None:
                fits[key] = params
        else:
            params = fits[key]
        if op == "drop_rows":
            before += (column,)
        elif op == "dedupe_rows":                     # what counts as a copy depends on every repair so far
            before += (tuple(ops.items())[:len(state.steps) + 1],)
        if any("table" in p for p in params):
            state.df = _join_spellings(state.df, column, params, f"_forms{len(state.steps)}")
        state.steps.append((op, column, params))
    state.rows_key = before
    return state


def _join_spellings(df: DataFrame, column: str, params: list[dict], name: str) -> DataFrame:
    """``name``: the form of the column's key by model, at most one entry per model."""
    tables = [p["table"].select(F.lit(m).alias("m"), F.col("key").alias("_key"), "form") for m, p in enumerate(params)]
    forms = reduce(DataFrame.unionByName, tables).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("m", "form"))).alias(name))
    return df.withColumn("_k", norm_key(F.col(f"`{column}`"))).join(forms, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def _keep_first_copies(state: FoldFit, row_id: str) -> None:
    """Mark, per model, the first training row of each group of copies (as that model sees them)."""
    cols = [c for c in state.df.columns if c != row_id and not c.startswith(("fold_", "_"))]
    keep = f"_keep{len(state.steps)}"
    seen = F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.coalesce(train, F.lit(False)).alias("in_train"),
                 *[state.value(c, i).cast("string").alias(f"c{j}") for j, c in enumerate(cols)])
        for i, train in enumerate(state.train)]))
    firsts = (state.df.select(F.col(row_id), seen.alias("s")).where("s.in_train")
              .groupBy("s.m", *[f"s.c{j}" for j in range(len(cols))]).agg(F.min(row_id).alias(row_id))
              .groupBy(row_id).agg(F.collect_set("m").alias(keep)))       # at most one entry per model
    state.df = state.df.join(firsts, row_id, "left")
    state.train = [t & F.coalesce(F.array_contains(keep, i), F.lit(False)) for i, t in enumerate(state.train)]
