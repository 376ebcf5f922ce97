"""SimHash fingerprints linked within a radius by covering locality-sensitive hashing.

Each of the 64 bits gets a vector of radius + 1 bits; for every non-zero vector v a table keeps the
bits whose vector has an odd product with v. The vectors of at most ``radius`` differing bits leave
some v orthogonal to all of them, so in that table the pair has the same key: no pair is missed.
Equal fingerprints are one node. A table's bucket is streamed in sorted order; up to ``bucket``
fingerprints are compared in memory and give a spanning set of links, larger buckets are covered
again on the bits they leave open. The vectors of these are chosen anew, so that every table narrows
its bucket; n open bits leave at most 2 ** n fingerprints, so the recursion ends with none left over.

Defined cases: null and empty texts have fingerprint zero and link like any other; a null doc_id is
kept, and takes part unless all ids of its component are null; repeated rows give repeated results;
an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm import jaccard
from tidegate.llm.components import components
from tidegate.llm.text import as_bytes, batch_of
from tidegate.session import written

BITS = 64
SEED = 42                      # of the shingle hash: a fixed value
STEP = 1 << 16                 # shingles counted at a time
BUCKET = 512                   # fingerprints of one bucket compared in memory
ROWS = 512                     # fingerprints covered at a time


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes."""
    raw = as_bytes(text).lower()                       # ASCII letters only, as bytes
    words = raw.split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    starts, stops = (stop - size)[:len(words) - width + 1], stop[width - 1:]
    votes, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), STEP):
        hashes = np.array([h(flat[a:b], SEED) for a, b in zip(starts[k:k + STEP].tolist(), stops[k:k + STEP].tolist())], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = np.packbits(votes * 2 > len(starts), bitorder="little")
    return int(on.view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and fp, the fingerprint as a signed 64-bit number."""
    at = len(carry)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(at)], pa.array(fp)], names=[*carry, "fp"])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*carry, F.col("text").alias("_t")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", fp bigint")


@lru_cache(None)
def vectors(n: int, radius: int) -> tuple[int, ...]:
    """A non-zero vector of radius + 1 bits for each of n > radius open bits, so that every non-zero v has an
    odd product with some of them, and with as many as a greedy choice reaches."""
    every = np.arange(1, 2 ** (radius + 1))
    odd = np.bitwise_count(every[:, None] & every[None, :]) & 1                       # by v and vector
    share, greedy = np.ones(len(every)), []
    for _ in range(n):
        greedy.append(int(np.argmin(share @ np.where(odd, 0.5, 1.0))))
        share = share * np.where(odd[:, greedy[-1]], 0.5, 1.0)
    top = [len(every) - 1 - i % len(every) for i in range(n)]                         # 64 bits: all tables keep half or more
    best = max((greedy, top), key=lambda x: odd[:, x].sum(axis=1).min())
    if not odd[:, best].any(axis=1).all():
        raise ValueError(f"no covering of {n} bits within {radius}")
    return tuple(int(every[i]) for i in best)


@lru_cache(1 << 15)
def masks(shared: int, radius: int) -> np.ndarray:
    """The tables over a bucket whose members share the bits ``shared``: the bits that each table's buckets share.
    Every one has more than ``shared``; one of all bits joins nothing and is left out."""
    left = [b for b in range(BITS) if not shared >> b & 1]
    of = dict(zip(left, vectors(len(left), radius)))
    out = [shared | sum(1 << b for b in left if (of[b] & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    if shared in out:
        raise ValueError("a table does not narrow its bucket")
    return np.array([m for m in out if m != (1 << BITS) - 1], np.uint64).view(np.int64)


def _spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what distances of at most ``radius`` connect: each member to its root."""
    bits = fps.view(np.uint64)                          # the count of a negative number is that of its absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])


def _scan(radius: int, bucket: int):
    """Streams (mask, key, fp) in order; yields links (a, b, null) and, for buckets of more than
    ``bucket`` members, these (fp, null, mask) to be covered again. Holds one bucket at most."""
    def emit(a, b=None, mask=None):
        return batch_of({"a": a, "b": pa.nulls(len(a), pa.int64()) if b is None else b,
                         "mask": pa.nulls(len(a), pa.int64()) if mask is None else mask}, LINKS)

    def runs(mask, key, fp, start, stop):
        n = stop - start
        two = start[n == 2]
        hit = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius
        yield emit(fp[two[hit] + 1], fp[two[hit]])
        linked = [_spanning(fp[s:e], radius) for s, e in zip(start[(n > 2) & (n <= bucket)], stop[(n > 2) & (n <= bucket)])]
        if linked:
            yield emit(np.concatenate([x for x, _ in linked]), np.concatenate([y for _, y in linked]))
        for s, e in zip(start[n > bucket], stop[n > bucket]):
            yield emit(fp[s:e], mask=mask[s:e])

    def run(batches):
        held, large = None, None                      # rows of the open bucket; the open bucket's name once it is too large
        for b in _with_end(batches):
            if b is not None:
                new = tuple(b.column(i).to_numpy() for i in range(3))
                rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            elif held is None:
                return
            else:
                rows = held
            mask, key, fp = rows
            if large is not None and len(fp):
                same = int(((mask == large[0]) & (key == large[1])).sum())          # a prefix, as rows are sorted
                yield emit(fp[:same], mask=mask[:same])
                mask, key, fp = mask[same:], key[same:], fp[same:]
                large = None if len(fp) else large
            if not len(fp):
                held = None
                continue
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            if b is None:
                yield from runs(mask, key, fp, start, stop)
                return
            yield from runs(mask, key, fp, start[:-1], stop[:-1])
            held = mask[start[-1]:], key[start[-1]:], fp[start[-1]:]
            if len(held[2]) > bucket:
                yield emit(held[2], mask=held[0])
                large, held = (held[0][0], held[1][0]), None
    return run


def _with_end(batches):
    yield from batches
    yield None


def _covered(radius: int):
    """(mask, key, fp) of every table over the bucket whose members share the bits of ``shared``."""
    def run(batches):
        for b in batches:
            shared, fp = (b.column(i).to_numpy() for i in range(2))
            for m in np.unique(shared):
                own, tables = fp[shared == m], masks(int(m) & (1 << BITS) - 1, radius)
                for k in range(0, len(own), ROWS):
                    part = own[k:k + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(tables, len(part))), pa.array((part[:, None] & tables[None, :]).ravel()),
                                                      pa.array(np.repeat(part, len(tables)))], names=["mask", "key", "fp"])
    return run


def near_links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints of ``nodes`` (column fp, each once) whose closure is
    the closure of all pairs within ``radius``."""
    todo, links = nodes.select(F.lit(0).cast("bigint").alias("mask"), "fp"), None
    most = max(bucket, 2 ** radius)                   # so a larger bucket has more than ``radius`` open bits
    for level in range(BITS):                         # a mask grows at each level
        rows = todo.mapInArrow(_covered(radius), "mask bigint, key bigint, fp bigint")
        rows = rows.distinct() if level else rows     # several ways may lead to one bucket
        out = written(rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
                      .mapInArrow(_scan(radius, most), "a bigint, b bigint, mask bigint"), "near")
        found = out.where("b IS NOT NULL").select("a", "b")
        links = found if links is None else links.unionByName(found)
        todo = out.where("b IS NULL").select("mask", F.col("a").alias("fp"))
        if todo.isEmpty():
            return links.distinct()
    raise ValueError("buckets are left that no table narrows")


def near_classes(marked: DataFrame, radius: int = 4) -> DataFrame:
    """fp and component_id, the smallest doc_id of all documents whose fingerprints are linked.
    ``marked`` has doc_id and fp."""
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(near_links(nodes.select("fp"), radius), "a", "b")             # node, root: only linked nodes
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.join(least, "root").select("fp", "component_id")


def covered_links(sets: DataFrame, docs: DataFrame, nodes: DataFrame, spec: jaccard.JoinSpec, radius: int) -> DataFrame:
    """x, y: links between sets (node, n, sketch, fp) that SimHash proposes and their texts confirm. Sets of one
    fingerprint are compared with the first of them, linked fingerprints through their first sets."""
    firsts = written(sets.groupBy("fp").agg(F.min("node").alias("lead")), "set-fingerprints")
    same = sets.join(firsts, "fp").where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    of = lambda c, n: firsts.select(F.col("fp").alias(c), F.col("lead").alias(n))
    near = near_links(firsts.select("fp"), radius).join(of("a", "p"), "a").join(of("b", "q"), "b")
    pairs = written(same.unionByName(near.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))).distinct(), "simhash-pairs")
    return jaccard.checked(pairs, jaccard.with_roots(sets, None, spec), docs, nodes, spec)


def near_copies(docs: DataFrame, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id, mark (of the text), component_id, first_mark of every row whose words are those of another document, exactly or with
    at least ``similarity`` of all five-word shingles in common. component_id and first_mark name the document that
    stands for all: the one with the smallest doc_id, and among texts of one doc_id the smallest mark. Rows without a doc_id
    take no part; texts without words are copies of each other.

    The covering tables over SimHashes give the first links, confirmed on whole texts. Pairs that SimHash does not
    propose are found by inverted lists of the rarest shingles, where sets that are linked already are not compared again.
    """
    docs = docs.where("doc_id IS NOT NULL")
    spec = jaccard.JoinSpec(width=5, percent=round(100 * similarity))
    rows, nodes, sets = jaccard.set_nodes(docs, spec, 0, simhash=True)
    roots = jaccard.scan_links(sets, docs, nodes, 0, covered_links(sets, docs, nodes, spec, radius), spec)
    every = written(rows.join(jaccard.classes_of(nodes, roots), F.col("key") == F.col("_key")).select("doc_id", "mark", "component_id", "first_mark"), "near-copies")
    own = (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("first_mark"))
    groups = every.where(~own).select(F.col("component_id").alias("_id"), F.col("first_mark").alias("_mark")).distinct()
    return every.join(groups, (F.col("component_id") == F.col("_id")) & (F.col("first_mark") == F.col("_mark")), "left_semi")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
