"""Documents linked by the Jaccard similarity of their shingle sets: a size-aware heavy-light join.

Equal sets are one node. Two sets of sizes n <= m are similar enough only if they share a subset of
``needed(n, m)`` shingles. Small sets enumerate all their subsets of that size for every partner size: who
shares one needs no further check, and a list of them is linked through one member of the
smaller size, so nothing grows with the square of a list. Large sets scan inverted lists: sets are
ordered from their rarest shingle on, and a similar pair shares one of the first n - needed + 1 and
m - needed + 1. Each set keeps a parity sketch, one bit a bin of its shingles: bits that differ come from
different shingles that only one set of a pair has, so a pair with more of them than similar sets may have is
dropped without its texts, and no similar one ever is. The other pairs are checked on whole texts. The boundary between
small and large is the size at which enumerating and scanning together cost the least, counted on all sets.

Short lists are compared at once. Longer ones are settled in rounds of leaders: the first compares
one leader with all, every later one ``step`` times as many, only between sets that are not
yet linked, and as soon as the pairs that are left are few against all rows, all of them. A list ends when its members are
linked or have been compared, so none is capped, and a group of near copies costs pairs in proportion to it.

How frequent shingles are is counted over all texts in a fixed number of hash bins: it orders shingles, so
collisions only move cost.

Defined cases: a null text or one without words has an empty set, links with nothing and is its own
component; a null doc_id takes part, and a component's id is the smallest that is not null (null if there
is none); rows that repeat a doc_id are rows of their own; an empty table gives no rows; other
columns are ignored.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidegate.llm.chaining import kmer_hashes, scramble, small_enough, word_hashes
from tidegate.llm.components import components
from tidegate.llm.text import as_bytes, batch_of
from tidegate.session import few_files, written


@dataclass(frozen=True)
class JoinSpec:
    width: int = 4                 # words of a shingle
    percent: int = 85              # 100 * intersection >= percent * union
    bins: int = 1 << 17            # of the shingle counts that order shingles
    sketch: int = 8                # 64-bit words of a parity sketch
    most_keys: int = 2_000         # subsets of one set up to which a size may count as small
    check_cost: int = 30           # a checked pair against an emitted row, for the boundary
    short: int = 4                 # members of a list that is compared at once
    step: int = 16                 # leaders of a round against those of all before
    close: int = 4                 # pairs per row of all lists up to which the rest is compared at once
    small: int = 500_000           # rows of an id table that may be broadcast

    def needed(self, n: int, m: int) -> int:
        """Shingles that sets of n and m must share."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, n: int) -> range:
        """Sizes that a set of n may be linked with."""
        return range(max(1, -(-self.percent * n // 100)), 100 * n // self.percent + 1)

    def keys(self, n: int, most: int) -> int:
        """Subsets that a set of n enumerates where sizes up to ``most`` are small."""
        return sum(comb(n, self.needed(n, m)) for m in self.partners(n) if m <= most)

    @property
    def limit(self) -> int:
        """The largest size that may count as small."""
        n = 1
        while self.keys(n + 1, n + 1) <= self.most_keys:
            n += 1
        return n


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the different shingles; the whole text as one if it has fewer words."""
    words = word_hashes(as_bytes(text).lower())
    return np.unique(kmer_hashes(words, max(1, min(width, len(words)))))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


MARKS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("bin", pa.int32()), ("count", pa.int64())])


def _bin(s: np.ndarray, bins: int) -> np.ndarray:
    return (s % np.uint64(bins)).astype(np.int64)


def marked(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    """One pass over all texts: doc_id, mark (of the text), n and key of every row, and the counts of every shingle bin."""
    def run(batches):
        counts = np.zeros(spec.bins, np.int64)
        for b in batches:
            sizes, keys = [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), spec.width)
                np.add.at(counts, _bin(s, spec.bins), 1)
                sizes.append(len(s)), keys.append(set_key(s))
            none = [None] * len(sizes)
            yield batch_of({"doc_id": b.column(0), "mark": b.column(1), "n": sizes, "key": keys, "bin": none, "count": none}, MARKS)
        at = np.flatnonzero(counts)
        none = [None] * len(at)
        yield batch_of({"doc_id": none, "mark": none, "n": none, "key": none, "bin": at.astype(np.int32), "count": counts[at]}, MARKS)
    return rows_of(docs).mapInArrow(run, "doc_id bigint, mark bigint, n int, key binary, bin int, count bigint")


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def rarity(marks: DataFrame, spec: JoinSpec) -> np.ndarray:
    """The count of every bin: a fixed number of numbers."""
    out = np.zeros(spec.bins, np.int64)
    for r in marks.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("count").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def parity(s: np.ndarray, words: int) -> np.ndarray:
    """Bit i tells whether an odd number of the shingles fall into bin i."""
    bits = np.bincount((scramble(s) >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def majority(s: np.ndarray) -> int:
    """SimHash of a set: bit i is set if it is set in more than half of the shingles' hashes."""
    votes, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(s), step):
        votes += np.unpackbits(s[k:k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(s), bitorder="little").view("<i8")[0])


ORDERED = pa.schema([("key", pa.binary()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("fp", pa.int64())])


def ordered_sets(docs: DataFrame, often: np.ndarray, spec: JoinSpec, limit: int, simhash: bool = False) -> DataFrame:
    """key, n, tokens, sketch, fp: each set's shingles from the rarest on, as many as any partner asks for (all of a set of at
    most ``limit``, which may be small), its parity sketch and, if ``simhash``, its SimHash."""
    counts = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        for b in batches:
            out = {name: [] for name in ORDERED.names}
            for t in b.column(0):
                s = shingle_set(t.as_py(), spec.width)
                if not len(s):
                    continue
                n = len(s)
                take = n if n <= limit else n - spec.needed(n, spec.partners(n)[0]) + 1
                order = np.lexsort((scramble(s), counts.value[_bin(s, spec.bins)]))
                out["key"].append(set_key(s)), out["n"].append(n), out["tokens"].append(s[order[:take]].view(np.int64))
                out["sketch"].append(parity(s, spec.sketch)), out["fp"].append(majority(s) if simhash else None)
            yield batch_of(out, ORDERED)
    return docs.select("text").mapInArrow(run, "key binary, n int, tokens array<bigint>, sketch array<bigint>, fp bigint")


def scanned(sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """token, node, n, rank (and root, if ``sets`` has it): the tokens of each set that a scan looks up, with their place in its order."""
    take = F.col("n") - spec_needed(F.col("n"), F.ceil(F.col("n") * spec.percent / 100), spec) + 1
    more = [c for c in sets.columns if c == "root"]
    rows = sets.select("node", "n", *more, F.posexplode(F.slice("tokens", F.lit(1), take.cast("int"))).alias("rank", "token"))
    return rows.select("token", "node", "n", "rank", *more)


def spec_needed(n, m, spec: JoinSpec):
    """``JoinSpec.needed`` of columns."""
    return F.ceil((n + m) * spec.percent / (100 + spec.percent) - 1e-9)


def boundary(sets: DataFrame, spec: JoinSpec) -> int:
    """The largest size that enumerates subsets: the cheapest of all sizes that may."""
    few = sets.where(F.col("n") <= spec.limit)
    number = {r["n"]: r["count"] for r in few.groupBy("n").count().collect()}
    if not number:
        return 0
    rows = scanned(few, spec)
    lists = rows.groupBy("token").agg(F.count("*").alias("members"))
    cost = rows.join(lists, "token").groupBy("n").agg(F.sum(1 + spec.check_cost * (F.col("members") - 1)).alias("cost")).collect()
    scan = {r["n"]: r["cost"] for r in cost}

    def total(x: int) -> float:
        return sum(c * spec.keys(n, x) for n, c in number.items() if n <= x) + sum(c for n, c in scan.items() if n > x)
    return min(range(spec.limit + 1), key=total)


SUBSETS = pa.schema([("subset", pa.int64()), ("node", pa.int64()), ("low", pa.bool_())])


@lru_cache(256)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)


def subset_links(sets: DataFrame, most: int, spec: JoinSpec) -> DataFrame:
    """a, b: links between sets of at most ``most`` shingles, by equal subsets of the size that they must share.

    A subset's list holds sets of two sizes; each is similar to every one of the smaller size, so it is linked to
    the first of those, and two of the larger size alone say nothing."""
    def run(batches):
        for b in batches:
            keys, nodes, lows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for node, tokens in zip(b.column(0).to_pylist(), b.column(1)):
                s = np.sort(tokens.values.to_numpy()).view(np.uint64)
                for m in spec.partners(len(s)):
                    if m > most:
                        continue
                    low, high = min(m, len(s)), max(m, len(s))
                    h = kmer_hashes_of(s[_choices(len(s), spec.needed(low, high))], low, high)
                    keys.append(h), nodes.append(np.full(len(h), node)), lows.append(np.full(len(h), len(s) == low))
            yield batch_of({"subset": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes), "low": np.concatenate(lows)}, SUBSETS)
    few = sets.where(F.col("n") <= most).select("node", "tokens")
    rows = few.mapInArrow(run, "subset bigint, node bigint, low boolean")
    hubs = rows.groupBy("subset").agg(F.min(F.when(F.col("low"), F.col("node"))).alias("a"), F.count("*").alias("members"))
    return rows.join(hubs.where("members > 1 AND a IS NOT NULL"), "subset").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def kmer_hashes_of(rows: np.ndarray, low: int, high: int) -> np.ndarray:
    """A hash of every row of shingles and the two sizes."""
    h = np.full(len(rows), low << 32 | high, np.uint64)
    for j in range(rows.shape[1]):
        h = scramble(h * np.uint64(0x2545F4914F6CDD1D) + rows[:, j])
    return h


def list_pairs(x: DataFrame, y: DataFrame, most: int, spec: JoinSpec) -> DataFrame:
    """x, y: pairs of a common token that may be similar, each once."""
    x = x.select("token", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rank").alias("rx"), F.col("root").alias("ox"), "both")
    y = y.select("token", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rank").alias("ry"), F.col("root").alias("oy"))
    need = spec_needed(F.col("nx"), F.col("ny"), spec)
    fits = (F.least("nx", "ny") >= need) & (F.col("nx") - F.col("rx") >= need) & (F.col("ny") - F.col("ry") >= need)
    once = ~F.col("both") | (F.col("x") < F.col("y"))
    pairs = x.join(y, "token").where(once & (F.col("ox") != F.col("oy")) & (F.greatest("nx", "ny") > most) & fits)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def may_be_similar(pairs: DataFrame, marks: DataFrame, spec: JoinSpec) -> DataFrame:
    """The rows of ``pairs`` (x, y) that are not linked yet and whose sketches differ in no more bits than similar sets may;
    ``marks`` has node, n, sketch and root."""
    of = lambda c: marks.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("root").alias(f"r{c}"))
    both = pairs.join(of("x"), "x").join(of("y"), "y")
    apart = sum((F.bit_count(F.col("sx")[i].bitwiseXOR(F.col("sy")[i])) for i in range(1, spec.sketch)), F.bit_count(F.col("sx")[0].bitwiseXOR(F.col("sy")[0])))
    free = F.col("nx") + F.col("ny") - 2 * spec_needed(F.col("nx"), F.col("ny"), spec)
    return both.where((F.col("rx") != F.col("ry")) & (apart <= free)).select("x", "y")


def checked(pairs: DataFrame, marks: DataFrame, docs: DataFrame, nodes: DataFrame, spec: JoinSpec) -> DataFrame:
    """The rows of ``pairs`` (x, y) that are similar, those known to be linked left out."""
    some = written(few_files(may_be_similar(pairs, marks, spec), pairs.count()), "jaccard-close")
    ids = written(few_files(some.select(F.explode(F.array("x", "y")).alias("node")).distinct(), 2 * some.count()), "jaccard-ids")
    return written(similar(some, texts_of(docs, nodes, ids, spec), spec), "jaccard-links")        # whole texts: as many tasks as there are


def with_roots(sets: DataFrame, roots: DataFrame | None, spec: JoinSpec) -> DataFrame:
    """``sets`` with root, the smallest node that links reach; ``roots`` (node, root) has the linked nodes."""
    if roots is None:
        return sets.withColumn("root", F.col("node"))
    return sets.join(small_enough(roots.withColumnRenamed("node", "_node"), spec.small), F.col("node") == F.col("_node"), "left").select(
        *sets.columns, F.coalesce("root", "node").alias("root"))


def joined_roots(roots: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
    """node, root of what ``links`` (x, y) and the links behind ``roots`` reach together; None where nothing is linked."""
    new = 0 if links is None else links.count()
    if not new:
        return roots
    most = new + (0 if roots is None else roots.count())
    every = links if roots is None else links.unionByName(roots.select(F.col("node").alias("x"), F.col("root").alias("y")))
    return written(few_files(components(every, "x", "y", most), 2 * most), "jaccard-roots")


def similar(pairs: DataFrame, texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """The rows of ``pairs`` (x, y) whose whole texts (node, text) are similar enough."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        last, sx = None, None
        for b in batches:
            xs, ys = [], []
            for x, y, tx, ty in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if x != last:
                    last, sx = x, shingle_set(tx.as_py(), spec.width)
                sy = shingle_set(ty.as_py(), spec.width)
                common = len(np.intersect1d(sx, sy, assume_unique=True))
                if 100 * common >= spec.percent * (len(sx) + len(sy) - common):
                    xs.append(x), ys.append(y)
            yield batch_of({"x": xs, "y": ys}, schema)
    of = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"))
    return of("y").join(small_enough(pairs, spec.small), "y").join(of("x"), "x").select("x", "y", "tx", "ty").mapInArrow(run, "x bigint, y bigint")


def scan_links(sets: DataFrame, docs: DataFrame, nodes: DataFrame, most: int, known: DataFrame | None, spec: JoinSpec) -> DataFrame | None:
    """node, root of all nodes that ``known`` links (x, y) and those of the pairs in the inverted lists of ``sets`` with a set
    of more than ``most`` connect: the closure of all similar pairs. None where nothing is linked.

    Rows of lists are shuffled once: a window over each token counts its list, so no second copy of them is grouped."""
    roots = joined_roots(None, known)
    marks = with_roots(sets, roots, spec)
    own = W.partitionBy("token")
    shared = scanned(marks, spec).withColumns({"members": F.count("*").over(own), "lead": F.min("node").over(own),
                                               "_low": F.min("root").over(own), "_high": F.max("root").over(own)})
    lists = written(shared.where("_low < _high").drop("_low", "_high"), "jaccard-lists")
    facts = lists.agg(F.count("*").alias("rows"), F.max("members").alias("longest")).first()
    led, most_pairs = 0, None
    while facts["rows"] and (led == 0 or facts["longest"] > led):
        if led == 0:                               # short lists at once, of the others one leader
            live = lists.withColumn("both", F.col("members") <= spec.short)
            first, ends = F.col("both") | (F.col("node") == F.col("lead")), spec.short
        else:
            live = _unsettled(lists.where(F.col("members") > led).drop("root"), facts["rows"], roots, spec)
            left = live.agg(F.count("*").alias("rows"), F.sum((F.col("left") - 1) / 2).alias("pairs")).first()
            if not left["rows"]:
                break
            whole = left["pairs"] <= spec.close * facts["rows"]
            live = live.withColumn("both", F.lit(whole))
            ends = facts["longest"] if whole else spec.step * led
            most_pairs = 2 * left["pairs"]         # a leader meets a member from either side
            turn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("members")
            first = F.lit(whole) | ((turn >= (led if led > spec.short else 0)) & (turn < ends))
        pairs = written(few_files(list_pairs(live.where(first), live, most, spec), most_pairs), "jaccard-pairs")
        roots = joined_roots(roots, checked(pairs, marks, docs, nodes, spec))
        led = ends
    return roots


def _unsettled(lists: DataFrame, most: int, roots: DataFrame | None, spec: JoinSpec) -> DataFrame:
    """Of ``lists``, which have ``most`` rows at most, those whose members are not all linked yet, with each member's root and the list's length (left)."""
    own = W.partitionBy("token")
    spans = with_roots(lists, roots, spec).withColumns({"left": F.count("*").over(own), "_low": F.min("root").over(own), "_high": F.max("root").over(own)})
    return written(few_files(spans.where("_low < _high").drop("_low", "_high"), most), "jaccard-live")


def texts_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame, spec: JoinSpec) -> DataFrame:
    """node, text of the nodes in ``ids``: the text of the row that stands for the node, told from others of its doc_id by its hash."""
    wanted = nodes.join(small_enough(ids, spec.small), "node").select("node", "first_id", F.col("mark").alias("first_mark"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    texts = written(rows_of(docs).join(small_enough(wanted, spec.small), same).select("node", "text"), "jaccard-texts")
    return texts if texts.count() == ids.count() else texts.dropDuplicates(["node"])           # else rows are repeated


def set_nodes(docs: DataFrame, spec: JoinSpec, limit: int, simhash: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: every row's doc_id, mark, n and key; a node for each different set, empty ones too, with the row that
    stands for it; and each node's n, tokens, sketch and fp."""
    marks = written(marked(docs, spec), "jaccard-marks")
    rows = marks.where("bin IS NULL").select("doc_id", "mark", "n", "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    nodes = rows.groupBy("key").agg(first.alias("first")).select(
        "key", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("mark"), F.monotonically_increasing_id().alias("node"))
    nodes = written(nodes, "jaccard-nodes")
    named = ordered_sets(docs, rarity(marks, spec), spec, limit, simhash).dropDuplicates(["key"]).join(nodes.select("key", "node"), "key")
    return rows, nodes, written(named.select("node", "n", "tokens", "sketch", "fp"), "jaccard-sets")


def classes_of(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """_key, component_id and first_mark of every node: the smallest doc_id among the nodes of its root in ``roots`` (node, root), and its text's mark."""
    if roots is None:
        return nodes.select(F.col("key").alias("_key"), F.col("first_id").alias("component_id"), F.col("mark").alias("first_mark"))
    classed = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "key", "first_id", "mark", F.coalesce("root", "node").alias("root"))
    least = classed.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "mark")).alias("first"))
    return classed.join(least, "root").select(F.col("key").alias("_key"), F.col("first.first_id").alias("component_id"), F.col("first.mark").alias("first_mark"))


def link(docs: DataFrame, spec: JoinSpec = JoinSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows, nodes, sets = set_nodes(docs, spec, spec.limit)
    most = boundary(sets, spec)
    known = None
    if most:
        known = written(subset_links(sets, most, spec).select(F.col("a").alias("x"), F.col("b").alias("y")), "jaccard-subsets")
    roots = scan_links(sets.where(F.col("n") >= spec.partners(most + 1)[0]), docs, nodes, most, known, spec)
    found = rows.join(classes_of(nodes, roots), F.col("key") == F.col("_key"), "left")
    return found.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
