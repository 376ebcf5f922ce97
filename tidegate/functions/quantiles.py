"""Exact quantiles (linear interpolation) for many columns and row conditions at once.

The built-in ``percentile`` keeps one counter per distinct value, which is right for columns
with a bounded number of them. Beyond ``limit`` distinct values the wanted ranks are bracketed
instead: rows are counted in equal-width bins, the bin that holds a rank becomes its new value
range, and only a range with few rows left is ranked. Counts below the range keep the rank exact.
All ranks narrow together, one aggregation per round, and no task ever sorts or holds more than a
bounded number of values. NaN counts as NULL; infinite values are values.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

DIRECT_LIMIT = 200_000
BINS = 512


@dataclass(frozen=True)
class Ask:
    """Quantiles ``probs`` of ``value`` over the rows where ``where`` holds (all rows if None)."""
    name: str
    value: Column
    probs: tuple[float, ...] = (0.5,)
    where: Column | None = None

    def masked(self) -> Column:
        v = self.value.cast("double")
        v = F.when(~F.isnan(v), v)                        # NaN is no value, as NULL
        return v if self.where is None else F.when(self.where, v)


def exact_quantiles(df: DataFrame, asks: list[Ask], limit: int = DIRECT_LIMIT,
                    bound: int | None = None) -> dict[str, tuple | None]:
    """name -> tuple of quantiles, or None when no row qualifies. Collects one row per ask and pass.

    ``bound``: a known upper bound on the distinct values of any ask; without it they are counted
    first. The counters of one pass share the memory, so the limit is shared by its asks.
    """
    if not asks:
        return {}
    long = _long(df, asks)
    share = limit // max(1, -(-len(asks) // 15))
    narrow = set(range(len(asks)))
    if bound is None or bound > share:
        sizes = long.groupBy("i").agg(F.approx_count_distinct("v").alias("d")).collect()
        narrow = {r["i"] for r in sizes if r["d"] <= share}
        wide = {r["i"] for r in sizes} - narrow
    else:
        wide = set()
    out: dict[str, tuple | None] = {a.name: None for a in asks}
    if narrow:
        probs = sorted({p for i in narrow for p in asks[i].probs})
        got = (long.where(F.col("i").isin(sorted(narrow))).groupBy("i")
               .agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("q")).collect())
        for r in got:
            out[asks[r["i"]].name] = tuple(r["q"][probs.index(p)] for p in asks[r["i"]].probs)
    if wide:
        out.update(_bracketed(df, [asks[i] for i in sorted(wide)], limit))
    return out


@dataclass
class _Target:
    """One 0-based rank of one ask, and the value range known to hold it."""
    rank: int
    lo: float
    hi: float
    below: int
    inside: int


def _long(df: DataFrame, asks: list[Ask]) -> DataFrame:
    """(i, v): the value of every ask a row belongs to."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), a.masked().alias("v")) for i, a in enumerate(asks)]))
    return df.select(each.alias("x")).select("x.i", "x.v").where("v IS NOT NULL")


def _in_range(long: DataFrame, targets: list[tuple[int, int, _Target]], finite: dict[int, tuple[float, float]]) -> DataFrame:
    """(t, v, bin): the rows inside each target's range; bins grow with the value, and infinite values
    have bins of their own. The ranges are one row per target; Spark does not know the size of a local table and would
    sort and shuffle all values to a few keys, so they are broadcast."""
    rows = []
    for t, i, x in targets:
        low, high = (x.lo if math.isfinite(x.lo) else finite[i][0]), (x.hi if math.isfinite(x.hi) else finite[i][1])
        rows.append((i, t, x.lo, x.hi, low, high - low if math.isfinite(high - low) else high / 2 - low / 2))
    ranges = long.sparkSession.createDataFrame(rows, "i int, t int, lo double, hi double, base double, width double")
    part = F.when(F.col("width") > 0, (F.col("v") - F.col("base")) / F.col("width")).otherwise(0.0)
    bin_ = (F.when(F.col("v") == float("inf"), 2 * BINS + 1).when(F.col("v") == float("-inf"), -1)
            .otherwise(F.least(F.floor(part * (BINS - 1)), F.lit(2 * BINS))).cast("int"))
    return long.join(F.broadcast(ranges), "i").where(F.col("v").between(F.col("lo"), F.col("hi"))).select("t", "v", bin_.alias("bin"))


def _bracketed(df: DataFrame, asks: list[Ask], limit: int) -> dict[str, tuple]:
    long = _long(df, asks)
    real = F.when(F.abs("v") < float("inf"), F.col("v"))
    ends = {r["i"]: r for r in long.groupBy("i").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                                     F.min(real).alias("flo"), F.max(real).alias("fhi")).collect()}
    finite = {i: (r["flo"] or 0.0, r["fhi"] or 0.0) for i, r in ends.items()}
    spots = {(i, p): p * (ends[i]["n"] - 1) for i, a in enumerate(asks) for p in a.probs}
    which = sorted({(i, k) for (i, _), pos in spots.items() for k in (math.floor(pos), math.ceil(pos))})
    targets = [_Target(k, ends[i]["lo"], ends[i]["hi"], 0, ends[i]["n"]) for i, k in which]      # every rank narrows alone
    small = max(1000, limit // len(targets))
    while wide := [(t, i, x) for t, ((i, _), x) in enumerate(zip(which, targets)) if x.lo < x.hi and x.inside > small]:
        bins: dict[int, list] = {}
        for r in (_in_range(long, wide, finite).groupBy("t", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                  .orderBy("t", "bin").collect()):                       # at most 2 * BINS + 3 rows per rank
            bins.setdefault(r["t"], []).append(r)
        for t, _, x in wide:
            upto = x.below
            for r in bins[t]:
                if upto + r["n"] > x.rank:
                    if r["n"] == x.inside and (r["lo"], r["hi"]) == (x.lo, x.hi):
                        raise ArithmeticError(f"rank {x.rank}: the range {x.lo} .. {x.hi} does not shrink")
                    x.lo, x.hi, x.below, x.inside = r["lo"], r["hi"], upto, r["n"]
                    break
                upto += r["n"]
    rest = [(t, i, x) for t, ((i, _), x) in enumerate(zip(which, targets)) if x.lo < x.hi]
    found = {w: x.lo for w, x in zip(which, targets)}
    if rest:
        ranks = df.sparkSession.createDataFrame([(t, x.rank - x.below) for t, _, x in rest], "t int, k bigint")
        steps = (_in_range(long, rest, finite).groupBy("t", "v").agg(F.count("*").alias("n"))
                 .withColumn("upto", F.sum("n").over(W.partitionBy("t").orderBy("v"))).join(F.broadcast(ranks), "t"))      # at most ``small`` rows per t
        for r in steps.where("upto > k").groupBy("t").agg(F.min("v").alias("x")).collect():
            found[which[r["t"]]] = r["x"]

    def value(i: int, p: float) -> float:
        pos = spots[(i, p)]
        x0, x1 = found[(i, math.floor(pos))], found[(i, math.ceil(pos))]
        return float(x0 if x0 == x1 else x0 + (x1 - x0) * (pos - math.floor(pos)))
    return {a.name: tuple(value(i, p) for p in a.probs) for i, a in enumerate(asks)}
