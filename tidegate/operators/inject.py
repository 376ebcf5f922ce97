"""Declared damage with an answer key.

Rows are drawn in seeded hash order, so the damage is exact in size and the same on every
retry. The answer key (manifest) is a separate table that deciding code is never given.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.functions.hashing import Cut, Draw, draw_cuts, in_draw, seeded_hash
from tidegate.functions.text import respelled


@dataclass(frozen=True)
class DefectSpec:
    id: str
    kind: str                       # category_variants | sentinel | mixed_units | nulls
    column: str
    rate: float
    value: float | None = None
    factor: float | None = None
    expected_fix: str | None = None
    expected_commit: bool = True


KINDS = ("category_variants", "sentinel", "mixed_units", "nulls")


def _new_value(spec: DefectSpec, seed: str, row_id: str) -> Column:
    c = F.col(spec.column)
    if spec.kind == "category_variants":
        digit = F.conv(F.substring(seeded_hash(seed, row_id), 32, 1), 16, 10).cast("int")
        return respelled(c, digit % 4)
    if spec.kind == "sentinel":
        return F.lit(spec.value)
    if spec.kind == "mixed_units":
        return c.cast("double") * F.lit(float(spec.factor))
    return F.lit(None)


def _damage(df: DataFrame, spec: DefectSpec, draw: Draw, cut: Cut, row_id: str) -> tuple[DataFrame, DataFrame]:
    new = _new_value(spec, draw.seed, row_id)
    old_type = df.schema[spec.column].dataType
    new_type = "double" if spec.kind == "mixed_units" else old_type
    old, new = F.col(spec.column).cast(new_type), new.cast(new_type)
    hit = in_draw(draw, cut, row_id)
    if spec.kind == "category_variants":
        hit = hit & (new != old)            # a re-spelling that changes nothing is not damage
    manifest = df.where(hit).select(
        F.lit(spec.id).alias("defect_id"), F.lit(spec.kind).alias("kind"), F.lit(spec.column).alias("column"),
        F.col(row_id).alias("row_id"), F.col(spec.column).cast("string").alias("original"))
    return df.withColumn(spec.column, F.when(hit, new).otherwise(old)), manifest


def inject(df: DataFrame, specs: list[DefectSpec], seed: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(damaged table, manifest). A later spec sees the damage of an earlier one.

    Specs on different columns do not see each other, so their draws share one counting pass.
    """
    manifests = []
    todo = list(specs)
    for s in todo:
        if s.kind not in KINDS:
            raise ValueError(f"unknown damage kind {s.kind}")
    while todo:
        batch: list[DefectSpec] = []
        while todo and todo[0].column not in [s.column for s in batch]:
            batch.append(todo.pop(0))
        draws = [Draw(s.id, f"{seed}:{s.id}", s.rate,
                      F.col(s.column).isNotNull() if s.kind == "category_variants" else None) for s in batch]
        cuts = draw_cuts(df, row_id, draws)
        for s, d in zip(batch, draws):
            df, m = _damage(df, s, d, cuts[d.name], row_id)
            manifests.append(m)
    return df, reduce(DataFrame.unionByName, manifests)
