"""Best-fit packing of token pieces by the linear grouping scheme.

Pieces are dealt to shards of bounded size. In a shard, lengths above ``small`` are sorted and cut
into groups of equal cardinality; each group counts as its largest length, which leaves a few sizes.
The linear programme over configurations of these sizes is solved by column generation (the
pricing problem is a knapsack over the token capacity), its whole parts are filled with the groups'
actual documents, and everything left, large or small, goes best-fit into the room that the rounding
and the configurations leave, before a new sequence is opened. The half of the open sequences with most
free tokens is then dissolved and packed best-fit once more, while that saves a sequence.

Defined cases: a null or empty text is the single id ``end_id``; ties in length keep the order of
the shard; repeated rows and null doc_ids are packed like any other; an empty table gives no rows;
a text longer than the capacity is cut into full pieces and one rest; other columns are ignored.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegate.llm.text import batch_of
from tidegate.llm.tokens import tokenizer
from tidegate.session import written


@dataclass(frozen=True)
class PackSpec:
    vocabulary: str                 # path of the tokenizer file, the same on every machine
    capacity: int = 2048
    end_id: int = 0
    shard_rows: int = 16_384        # pieces packed together
    groups: int = 128               # sizes of the linear programme
    small: int = 512                # lengths up to this are only placed best-fit


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, spec: PackSpec) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""
    def run(batches):
        packed, end, step = tokenizer(spec.vocabulary).packed, spec.end_id.to_bytes(4, "little"), 4 * spec.capacity
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = packed(text.as_py() or "") + end
                rows += [(doc, k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at:at + step])) for k, at in enumerate(range(0, len(ids), step))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield batch_of(dict(zip(PIECE.names, cols)), PIECE)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable configuration: knapsack over the capacity, one vector step per size and copy."""
    best = np.zeros(capacity + 1)
    steps = []
    for i in np.flatnonzero(duals > 1e-12):
        s = sizes[i]
        for _ in range(capacity // s):
            other = best.copy()
            np.maximum(best[s:], best[:-s] + duals[i], out=other[s:])
            if (other == best).all():
                break
            steps.append((i, best))
            best = other
    use, at, now = np.zeros(len(sizes), np.int64), capacity, best
    for i, before in reversed(steps):
        if now[at] > before[at]:
            use[i] += 1
            at -= sizes[i]
        now = before
    return float(best[capacity]), use


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Basic solution of min sum x, sum config * x >= demand, by column generation."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)           # a column is a configuration
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for step in range(rounds):
        value, use = _price(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ use
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * d
        x[out] = theta
        basis[:, out] = use
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis.astype(np.int64), np.maximum(x, 0)


class _Room:
    """Open sequences by free tokens; the tightest that still fits is found by a scan of a bit set."""

    def __init__(self, capacity: int):
        self.lists, self.mask = [[] for _ in range(capacity + 1)], 0

    def put(self, free: int, seq: int) -> None:
        self.lists[free].append(seq)
        self.mask |= 1 << free

    def take(self, need: int) -> tuple[int, int] | None:
        up = self.mask >> need
        if not up:
            return None
        free = need + (int(up) & -int(up)).bit_length() - 1
        own = self.lists[free]
        seq = own.pop()
        if not own:
            self.mask ^= 1 << free
        return free, seq


def pack(length: np.ndarray, spec: PackSpec) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every length; sequences are numbered from 0."""
    cap = spec.capacity
    seq, off = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
    full = np.flatnonzero(length == cap)
    seq[full] = np.arange(len(full))
    used = len(full)
    large = np.flatnonzero((length > spec.small) & (length < cap))
    large = large[np.argsort(-length[large], kind="stable")]
    room = _Room(cap)
    if len(large):
        parts = [p for p in np.array_split(large, min(spec.groups, len(large))) if len(p)]
        sizes = np.array([length[p[0]] for p in parts])
        same = np.flatnonzero(np.diff(sizes, prepend=-1))                     # groups of one size are one group
        parts = [np.concatenate(parts[a:b]) for a, b in zip(same, [*same[1:], len(parts)])]
        sizes = sizes[same]
        config, times = configurations(sizes, np.array([len(p) for p in parts], float), cap)
        queue = [list(p[::-1]) for p in parts]                                # pop() gives the longest first
        for c, n in zip(config.T, np.floor(times + 1e-9).astype(int)):
            order = [int(i) for i in np.flatnonzero(c) for _ in range(c[i])]
            for _ in range(n):
                at = 0
                for i in order:
                    if queue[i]:
                        d = queue[i].pop()
                        seq[d], off[d] = used, at
                        at += length[d]
                if at:
                    room.put(int(cap - at), used)
                    used += 1
    used = _best_fit(length, np.flatnonzero(seq < 0), seq, off, room, used, cap)
    for _ in range(8):
        again = _dissolved(length, seq, off, used, cap)
        if again is None:
            break
        seq, off, used = again
    return seq, off


def _best_fit(length, which, seq, off, room: _Room, used: int, cap: int) -> int:
    """Longest first into the tightest room, else into a new sequence; returns the number of sequences."""
    for d in which[np.argsort(-length[which], kind="stable")].tolist():
        need = int(length[d])
        got = room.take(need)
        free, s = got if got else (cap, used)
        used += got is None
        seq[d], off[d] = s, cap - free
        if free > need:
            room.put(free - need, s)
    return used


def _dissolved(length, seq, off, used: int, cap: int):
    """The packing after its looser half went best-fit again; None if no sequence is saved."""
    free = cap - np.bincount(seq, weights=length, minlength=used).astype(np.int64)
    open_ = np.flatnonzero(free > 0)
    loose = open_[np.argsort(-free[open_], kind="stable")][:max(2, -(-len(open_) // 2))]
    name = np.zeros(used, np.int64)
    name[loose] = -1
    kept = name == 0
    name[kept] = np.arange(kept.sum())
    new_seq, new_off = name[seq], off.copy()
    now = _best_fit(length, np.flatnonzero(new_seq < 0), new_seq, new_off, _Room(cap), int(kept.sum()), cap)
    return (new_seq, new_off, now) if now < used else None


def pack_documents(docs: DataFrame, spec: PackSpec) -> DataFrame:
    """Pieces with sequence_id and offset. Sequence numbers are the shard's times 2 ** 32 plus its own."""
    cut = written(pieces(docs, spec), "pieces")
    shards = max(1, -(-cut.count() // spec.shard_rows))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))     # of a written table: the same on a retry

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        seq, off = pack(t["length"].to_numpy(), spec)
        base = t["shard"][0].as_py() << 32
        return t.select(PIECE.names).append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off))
    return dealt.groupBy("shard").applyInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
