"""Mixing sources to target weights: equal-word blocks, given to sources by highest averages.

A source is cut into shards of bounded size by a seeded hash; a shard's documents, in seeded order,
form one run of words, cut into blocks of ``block_words``. Whole blocks are given to sources
(Sainte-Laguë over their targets), then to bands of shards, then to shards; inside a shard a seeded
choice takes every block floor(q / n) times and q mod n of them once more. Only counts travel to
the driver: one row per source and one per band of 1,024 shards (268 million words).

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; documents
without words are in the result with 0 words taken; repeated rows are separate documents; an empty
table gives no rows. Clashing columns cannot arise: the input is projected to the named columns.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.apportion import sainte_lague, shares
from tidegate.llm.text import WORD
from tidegate.session import written

BAND = 1024


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)     # by source in code point order, repeating
    total: float = 1.5                               # words wanted, as a share of all words
    times: float = 2.0                               # no source is read more often than this
    block_words: int = 16
    run_blocks: int = 1                              # blocks chosen together, to keep texts in long runs
    shard_words: int = 1 << 18
    shard_rows: int = 50_000
    seed: int = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _seed(seed: int, sid: int, shard: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, (sid << 40) ^ shard]))


def block_counts(words: int, quota: int, block: int, rng: np.random.Generator, run: int = 1) -> np.ndarray:
    """How often each block of a shard is taken; the choice is of ``run`` neighbours at a time, the last one cut."""
    n = -(-words // block)
    base, extra = divmod(quota, n)
    counts = np.full(n, base, np.int64)
    order = (rng.permutation(-(-n // run))[:, None] * run + np.arange(run)).ravel()
    counts[order[order < n][:extra]] += 1
    return counts


def taken_before(counts: np.ndarray, block: int, at: np.ndarray) -> np.ndarray:
    """Words the mix takes from the first ``at`` words of a shard."""
    full = np.concatenate([[0], np.cumsum(counts)]) * block
    k = at // block
    return full[k] + np.append(counts, 0)[k] * (at % block)


def source_targets(sized: DataFrame, spec: MixSpec) -> list[dict]:
    """One row per source: sid, source, words, rows, target. A source list is part of a mixture's
    recipe, so it is small enough for the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    w = [spec.weights[i % len(spec.weights)] for i in range(len(rows))]
    goal = shares([r["words"] for r in rows], w, spec.total * sum(r["words"] for r in rows), spec.times)
    return [{"sid": i, "source": r["source"], "words": r["words"], "n": r["n"], "target": t,
             "shards": max(1, -(-r["words"] // spec.shard_words), -(-r["n"] // spec.shard_rows))}
            for i, (r, t) in enumerate(zip(rows, goal))]


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), carry: tuple[str, ...] = ("doc_id",), texts: bool = False) -> DataFrame:
    """``carry`` columns, size, source_size, target, taken; with ``texts`` also ``spans``: the runs
    (start word, end word, times) of each document that the mix takes."""
    spark = docs.sparkSession
    sized = docs.select(*[F.col(c).alias(f"k_{c}") for c in carry], F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size"))
    counted = written(sized.select("id", "source", "size"), "mix-sizes")
    sources = source_targets(counted, spec)
    table = spark.createDataFrame([(s["sid"], s["source"], s["words"], float(s["target"]), s["shards"]) for s in sources],
                                  "sid bigint, src string, source_size bigint, target double, shards bigint")

    def sharded(df: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64(F.lit(spec.seed), "id", "size"), F.col("shards"))
        return df.join(table, df["source"].eqNullSafe(table["src"])).withColumn("shard", shard).drop("src", "shards")

    words = (sharded(counted.where("size > 0")).groupBy("sid", "shard").agg(F.sum("size").alias("words"))
             .withColumn("band", F.floor(F.col("shard") / BAND)))
    bands = words.groupBy("sid", "band").agg(F.sum("words").alias("words"), F.sum(F.ceil(F.col("words") / spec.block_words)).alias("blocks")).collect()
    quotas = spark.createDataFrame(_band_quotas(sources, bands, spec), "sid bigint, band bigint, quota bigint")
    given = words.join(quotas, ["sid", "band"]).groupBy("sid", "band").applyInArrow(_shard_quotas(spec), "sid bigint, shard bigint, quota bigint")
    full = counted.withColumn("k_doc_id", F.col("id")) if carry == ("doc_id",) else sized
    kept = [*[f"k_{c}" for c in carry], "size", "source_size", "target"]
    placed = sharded(full.where("size > 0")).join(given, ["sid", "shard"])
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", taken bigint, spans array<struct<start:bigint,stop:bigint,times:int>>"
    out = placed.groupBy("sid", "shard").applyInArrow(_select(spec, kept, texts), schema)
    bare = full.where("size = 0").join(table, full["source"].eqNullSafe(table["src"]))
    out = out.unionByName(bare.select(*kept, F.lit(0).cast("bigint").alias("taken"), F.array().cast(out.schema["spans"].dataType).alias("spans")))
    return out.select(*[F.col(f"k_{c}").alias(c) for c in carry], "size", "source_size", "target", "taken", *(["spans"] if texts else []))


def _band_quotas(sources: list[dict], bands: list, spec: MixSpec) -> list[tuple]:
    by = {}
    for r in bands:
        by.setdefault(r["sid"], []).append(r)
    caps = [int(spec.times * sum(b["blocks"] for b in by.get(s["sid"], []))) for s in sources]
    quota = sainte_lague([s["target"] for s in sources], round(sum(s["target"] for s in sources) / spec.block_words), caps)
    out = []
    for s, q in zip(sources, quota):
        own = sorted(by.get(s["sid"], []), key=lambda b: b["band"])
        given = sainte_lague([b["words"] for b in own], q, [int(spec.times * b["blocks"]) for b in own])
        out += [(s["sid"], b["band"], g) for b, g in zip(own, given)]
    return out


def _shard_quotas(spec: MixSpec):
    def give(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        words = t["words"].to_pylist()
        caps = [int(spec.times * -(-w // spec.block_words)) for w in words]
        got = sainte_lague([float(w) for w in words], t["quota"][0].as_py(), caps)
        return pa.table({"sid": t["sid"], "shard": t["shard"], "quota": pa.array(got, pa.int64())})
    return give


def _select(spec: MixSpec, kept: list[str], texts: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("times", pa.int32())]))

    def select(t: pa.Table) -> pa.Table:
        sid, shard, quota = (t[c][0].as_py() for c in ("sid", "shard", "quota"))
        rng = _seed(spec.seed, sid, shard)
        t = t.sort_by([("id", "ascending"), ("size", "ascending")])
        t = t.take(pa.array(rng.permutation(t.num_rows)))
        size = t["size"].to_numpy()
        stop = np.cumsum(size)
        start = stop - size
        counts = block_counts(int(stop[-1]), quota, spec.block_words, rng, spec.run_blocks)
        taken = taken_before(counts, spec.block_words, stop) - taken_before(counts, spec.block_words, start)
        spans = [spans_of(counts, spec.block_words, int(a), int(b)) for a, b in zip(start, stop)] if texts else [[] for _ in size]
        return t.select(kept).append_column("taken", pa.array(taken, pa.int64())).append_column("spans", pa.array(spans, spans_type))
    return select


def spans_of(counts: np.ndarray, block: int, start: int, stop: int) -> list[dict]:
    """Runs of equal times > 0 inside words [start, stop) of a shard, in the document's own word numbers."""
    first, last = start // block, -(-stop // block)
    c = counts[first:last]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
    return [{"start": max(start, (first + int(a)) * block) - start, "stop": min(stop, (first + int(b)) * block) - start, "times": int(c[a])}
            for a, b in zip(cut[:-1], cut[1:]) if c[a] > 0]
