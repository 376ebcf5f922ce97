"""Seeded order over rows by md5, and exact draws from it without sorting the table.

The order depends only on the seed and the row id, so it is the same in every engine and on
every retry. A draw of the first n rows needs no global sort: rows are counted by hash prefix
(a bounded table), the prefix that holds the n-th row is found, only that prefix is ranked, and
the draw itself becomes a map-side comparison with one literal.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

GROUP_ROWS = 4096          # a prefix group holds between this many and sixteen times as many rows
MAX_PREFIX = 6


def seeded_hash(seed: str, row_id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def hash_unit(seed: str, row_id: str) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(seeded_hash(seed, row_id), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def prefix_digits(rows: int) -> int:
    """Hex digits of the prefix so that one prefix group stays small at any table size."""
    if rows <= GROUP_ROWS:
        return 0
    return max(0, min(MAX_PREFIX, int(math.floor(math.log(rows / GROUP_ROWS) / math.log(16) + 1e-9))))


@dataclass(frozen=True)
class Draw:
    """The first round(rate * eligible) rows in hash order."""
    name: str
    seed: str
    rate: float
    eligible: Column | None = None


@dataclass(frozen=True)
class Cut:
    """Where a draw ends: rows up to this (hash, row id) are in it."""
    hash: str | None
    row_id: object
    rows: int
    eligible: int


def draw_cuts(df: DataFrame, row_id: str, draws: list[Draw]) -> dict[str, Cut]:
    """End point of every draw. Collects two rows per draw."""
    always = F.lit(True)
    counts = df.agg(*[F.count_if(always if d.eligible is None else d.eligible).alias(d.name) for d in draws]).first()
    want = {d.name: round(d.rate * counts[d.name]) for d in draws}   # round() is half-even
    digits = prefix_digits(max(counts))
    if digits:
        keyed = df.select(F.explode(F.array(*[
            F.when(always if d.eligible is None else d.eligible,
                   F.struct(F.lit(d.name).alias("draw"), F.substring(seeded_hash(d.seed, row_id), 1, digits).alias("p")))
            for d in draws])).alias("k")).where("k IS NOT NULL").select("k.*")
        run = W.partitionBy("draw").orderBy("p")      # at most 16^digits rows per draw
        wanted = df.sparkSession.createDataFrame(list(want.items()), "draw string, want bigint")
        before = (keyed.groupBy("draw", "p").agg(F.count("*").alias("n"))
                  .withColumn("before", F.sum("n").over(run) - F.col("n")))
        edge = {r["draw"]: (r["p"], r["left"]) for r in before.join(F.broadcast(wanted), "draw")
                .where("before < want AND want <= before + n")
                .select("draw", "p", (F.col("want") - F.col("before")).alias("left")).collect()}      # one row per draw
    else:
        edge = {k: ("", v) for k, v in want.items() if v > 0}
    near = []                                          # only rows of a draw's last prefix leave the scan
    for d in draws:
        if d.name in edge:
            h, (p, left) = seeded_hash(d.seed, row_id), edge[d.name]
            inside = F.substring(h, 1, digits) == p
            near.append(F.when(inside if d.eligible is None else d.eligible & inside,
                               F.struct(F.lit(d.name).alias("draw"), h.alias("h"), F.lit(left).cast("bigint").alias("left"))))
    ends = {}
    if near:
        ranked = (df.select(F.col(row_id).alias("rid"), F.explode(F.array(*near)).alias("k")).where("k IS NOT NULL").select("rid", "k.*")
                  .withColumn("rn", F.row_number().over(W.partitionBy("draw").orderBy("h", "rid")))
                  .where("rn = left"))
        ends = {r["draw"]: r for r in ranked.select("draw", "h", "rid").collect()}
    return {d.name: Cut(ends[d.name]["h"] if d.name in ends else None,
                        ends[d.name]["rid"] if d.name in ends else None,
                        want[d.name], counts[d.name]) for d in draws}


def in_draw(draw: Draw, cut: Cut, row_id: str) -> Column:
    """Map-side membership test of a draw."""
    if cut.hash is None:
        return F.lit(False)
    h = seeded_hash(draw.seed, row_id)
    inside = (h < cut.hash) | ((h == cut.hash) & (F.col(row_id) <= F.lit(cut.row_id)))
    return inside if draw.eligible is None else F.coalesce(draw.eligible, F.lit(False)) & inside


def ranked_in_class(df: DataFrame, cls: Column, row_id: str, seed: str, orders: int, digits: int) -> DataFrame:
    """Add ``rank_0 .. rank_{orders-1}``: exact 0-based ranks within a class, in seeded orders.

    One md5 per row: its prefix is the shuffle group, its later digits give one order per rank
    inside the group. Group offsets come from a bounded count table, so a class that holds half
    of all rows is still spread over 16^digits tasks.
    """
    h = seeded_hash(seed, row_id)
    keyed = df.withColumn("_rc", cls).withColumn("_rh", h).withColumn("_rp", F.substring(F.col("_rh"), 1, digits))
    width = (32 - MAX_PREFIX) // orders
    ranks = []
    for i in range(orders):
        piece = F.substring("_rh", 1 + MAX_PREFIX + i * width, width)
        rn = F.row_number().over(W.partitionBy("_rc", "_rp").orderBy(piece, F.col(row_id)))
        ranks.append((rn - 1).cast("bigint").alias(f"rank_{i}"))
    out = keyed.select(*[F.col(c) for c in df.columns], "_rc", "_rp", *ranks)
    if not digits:
        return out.drop("_rc", "_rp")
    sizes = keyed.groupBy("_rc", "_rp").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_rc", "_rp", (F.sum("_n").over(W.partitionBy("_rc").orderBy("_rp")) - F.col("_n")).alias("_o"))
    at = out["_rc"].eqNullSafe(offsets["_rc"]) & (out["_rp"] == offsets["_rp"])
    return out.join(offsets, at).select(
        *[out[c] for c in df.columns], *[(out[f"rank_{i}"] + offsets["_o"]).alias(f"rank_{i}") for i in range(orders)])
