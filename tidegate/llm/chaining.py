"""Fuzzy repeated passages by collinear chaining of word seeds.

Seeds are the minimizers of ``k``-word strings: every run of k + w - 1 equal words shares one. A seed
carries a hash of the ``reach`` = min_words - w + 1 words that begin at it, so every run of min_words
equal words holds a seed whose whole reach lies in the run. A seed is matched with its first occurrence,
the one in the smallest doc_id, with the one just before it, and with the first and the previous one of
equal reach: at most four matches for each row, however common the seed, and a run of min_words that an
earlier document has is found even where its seeds also occur elsewhere. A match of equal reach counts
as the seeds at both ends and the middle of the reach. Matches of two documents are chained in
order of both positions: a chain gains k per seed and pays ``gap_cost`` per skipped word, the best
predecessor is a prefix maximum in a Fenwick tree. Chains are cut at long gaps, their words are
fetched in blocks and aligned between the seeds and up to min_words beyond the ends; a passage of at least
``min_words`` words in the later document, ``similarity`` of them aligned, is a repeat. An alignment
that is less alike as a whole gives the parts of it that are.

Defined cases: words are compared with ASCII letters lower-cased; a null text has no words; rows with
a null doc_id take no part and keep their text; rows that repeat doc_id and text count as one document,
rows of one doc_id with different texts are documents of their own (only smaller ids make a repeat); an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidegate.llm.text import as_bytes, batch_of, small_enough, told_apart, word_spans
from tidegate.session import written

MIX = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20


@dataclass(frozen=True)
class ChainSpec:
    k: int = 5
    w: int = 8
    min_words: int = 50
    similarity: float = 0.8
    min_seeds: int = 3
    gap_cost: float = 0.1
    max_gap: int = 32               # words; chains are cut there
    block: int = 64                 # words of a text fetched together
    small: int = 500_000            # rows of an id table that may be broadcast

    @property
    def reach(self) -> int:
        return self.min_words - self.w + 1


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * MIX)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.array([1] + [b] * (n - 1), np.uint64), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word; the text is read in pieces, so memory is a few numbers a word."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE:
            end = at + PIECE
            while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        part = raw[at:end]
        start, stop = word_spans(part)
        if len(start):
            up, down = _powers(len(part) + 1)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(part, np.uint8)] * up[:len(part)], dtype=np.uint64)])
            out.append(scramble((run[stop] - run[start]) * down[start] + MIX * (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def kmer_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x2545F4914F6CDD1D) + words[j:j + n]
    return scramble(h)


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash (the first, if tied) of every window of w."""
    if len(h) <= w:
        return np.array([int(h.argmin())]) if len(h) else np.empty(0, np.int64)
    place, low_bits = np.arange(len(h), dtype=np.uint64), np.uint64((1 << 24) - 1)
    low, have = (h & ~low_bits) | (place & low_bits), 1                  # the place breaks ties and is read back
    while 2 * have <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[:have - w], low[w - have:])
    place = place[:len(low)]
    at = (place + ((low - place) & low_bits)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])]


def reach_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 31-bit hash of the n words from each position on; -1 where fewer follow."""
    up, down = _powers(len(words) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)])
    to = np.minimum(at + n, len(words))
    return np.where(at + n <= len(words), (scramble((run[to] - run[at]) * down[at]) >> np.uint64(33)).astype(np.int64), -1)


SEEDS = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("pos", pa.int32()), ("ahead", pa.int32())])


def seeds(docs: DataFrame, spec: ChainSpec) -> DataFrame:
    """seed, doc, twin, pos, ahead (hash of its reach) of every minimizer of every text that is long enough to hold a passage."""
    def run(batches):
        for b in batches:
            s, d, t, p, r = [np.empty(0, np.uint64)], *([np.empty(0, np.int64)] for _ in range(4))
            for doc, twin, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                words = word_hashes(as_bytes(text.as_py()).lower())
                if len(words) >= spec.min_words * spec.similarity:
                    h = kmer_hashes(words, spec.k)
                    at = minimizers(h, spec.w)
                    s.append(h[at]), p.append(at), d.append(np.full(len(at), doc)), t.append(np.full(len(at), twin)), r.append(reach_hashes(words, at, spec.reach))
            yield batch_of({"seed": np.concatenate(s).view(np.int64), "doc": np.concatenate(d), "twin": np.concatenate(t), "pos": np.concatenate(p).astype(np.int32),
                            "ahead": np.concatenate(r).astype(np.int32)}, SEEDS)
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", "twin").mapInArrow(run, "seed bigint, doc bigint, twin bigint, pos int, ahead int")


def matches(found: DataFrame) -> DataFrame:
    """a, a_twin, d, d_twin, pa, pd, alike: every seed of a document with its first occurrence and with the one just before,
    in order of (doc, pos), and with these two among the seeds of equal reach, where they are in smaller documents."""
    here = F.struct("doc", "twin", "pos", "ahead")
    every = W.partitionBy("seed").orderBy("doc", "twin", "pos")
    alike = W.partitionBy("seed", "ahead").orderBy("doc", "twin", "pos")
    placed = found.withColumns({"first": F.first(here).over(every), "last": F.lag(here).over(every), "next": F.lead("doc").over(every)})
    placed = (placed.where("last IS NOT NULL OR next IS NOT NULL")         # a seed that occurs once has no match
              .withColumns({"first_alike": F.first(here).over(alike), "last_alike": F.lag(here).over(alike)}))
    ends = F.filter(F.array_distinct(F.array("first", "last", "first_alike", "last_alike")), lambda x: x["doc"] < F.col("doc"))
    return (placed.withColumn("e", F.explode(ends))
            .select(F.col("e.doc").alias("a"), F.col("e.twin").alias("a_twin"), F.col("doc").alias("d"), F.col("twin").alias("d_twin"), F.col("e.pos").alias("pa"), F.col("pos").alias("pd"),
                    ((F.col("ahead") >= 0) & (F.col("ahead") == F.col("e.ahead"))).alias("alike")))


def spread(at: np.ndarray, dt: np.ndarray, alike: np.ndarray, spec: ChainSpec) -> tuple[np.ndarray, np.ndarray]:
    """The matches of one pair, sorted by dt, then at; a match of equal reach also stands for the seeds in
    the middle and at the end of its reach, unless the next match lies on its diagonal within the reach."""
    last = spec.reach - spec.k
    gap = np.append(np.diff(dt), last + 1)
    lone = alike & ~((np.append(np.diff(at), -1) == gap) & (gap <= last))
    if not lone.any():
        return at, dt
    both = np.sort(np.concatenate([(dt + x << 32) + at + x for dt, at, x in ((dt, at, 0), (dt[lone], at[lone], last // 2), (dt[lone], at[lone], last))]))
    both = both[np.append(True, both[1:] != both[:-1])]
    return both & 0xFFFFFFFF, both >> 32


def chains(at: np.ndarray, dt: np.ndarray, spec: ChainSpec) -> list[np.ndarray]:
    """Index arrays of the chains of matches (at, dt), which are sorted by dt, then at."""
    n, g, k = len(at), spec.gap_cost, float(spec.k)
    da, dd = at[1:] - at[:-1], dt[1:] - dt[:-1]
    if (da > 0).all() and (dd > 0).all() and (g * (da + dd) < k).all():
        whole = [np.arange(n)]                        # every step gains, so the chain of all is the best one
    else:
        rank = np.unique(at, return_inverse=True)[1] + 1
        size = int(rank.max())
        tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
        score, back = [0.0] * n, [-1] * n
        rank, a, d = rank.tolist(), at.tolist(), dt.tolist()
        i = 0
        while i < n:
            j = i
            while j < n and d[j] == d[i]:             # matches at one place of d cannot follow each other
                best, r = (-np.inf, -1), rank[j] - 1
                while r > 0:
                    if tree[r] > best:
                        best = tree[r]
                    r -= r & -r
                gain = best[0] - g * (a[j] + d[j])
                score[j] = k + max(0.0, gain)
                back[j] = best[1] if gain > 0 else -1
                j += 1
            for m in range(i, j):
                item, r = (score[m] + g * (a[m] + d[m]), m), rank[m]
                while r <= size:
                    if item > tree[r]:
                        tree[r] = item
                    r += r & -r
            i = j
        used, whole = [False] * n, []
        for end in np.argsort(-np.array(score), kind="stable").tolist():
            path = []
            while end >= 0 and not used[end]:
                used[end] = True
                path.append(end)
                end = back[end]
            if len(path) >= spec.min_seeds:
                whole.append(np.array(path[::-1]))
    out = []
    for c in whole:
        x, y = at[c], dt[c]
        cut = np.flatnonzero(np.maximum(x[1:] - x[:-1], y[1:] - y[:-1]) > spec.max_gap).tolist()
        out += [c[i + 1:j + 1] for i, j in zip([-1, *cut], [*cut, len(c) - 1]) if j - i >= spec.min_seeds]
    return out


def straight(at: np.ndarray, dt: np.ndarray, alike: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], spec: ChainSpec) -> list:
    """Chains along one diagonal through matches of equal reach, where ``found`` has none that runs straight
    there: a chain may leave a run of equal words for a stray seed, and its alignment then splits the run."""
    at, dt, last = at[alike], dt[alike], spec.reach - spec.k
    order = np.lexsort((dt, at - dt))
    at, dt = at[order], dt[order]
    shift = at - dt
    cut = (np.flatnonzero((shift[1:] != shift[:-1]) | (dt[1:] - dt[:-1] > spec.reach)) + 1).tolist()
    have: dict[int, list[tuple[int, int]]] = {}
    for x, y in found:
        off = x - y
        if (off == off[0]).all():
            have.setdefault(int(off[0]), []).append((int(y[0]), int(y[-1])))
    out = []
    for i, j in zip([0, *cut], [*cut, len(at)]):
        first, end = int(dt[i]), int(dt[j - 1]) + last
        if not any(lo <= first and hi >= end for lo, hi in have.get(int(shift[i]), ())):
            out.append((np.append(at[i:j], at[j - 1] + last), np.append(dt[i:j], end)))
    return out


PAIR = ["a", "a_twin", "d", "d_twin"]
CHAINS = pa.schema([*[(n, pa.int64()) for n in PAIR], *[(n, pa.list_(pa.int32())) for n in ("size", "ba", "bd")],
                    ("pa", pa.list_(pa.int32())), ("pd", pa.list_(pa.int32()))])


def chained(found: DataFrame, spec: ChainSpec) -> DataFrame:
    """a, a_twin, d, d_twin, size, ba, bd, pa, pd: the chains of every pair of documents, one after another with
    their sizes, and the blocks of words that their alignment needs; streamed pair by pair."""
    def blocks_of(spans: list[np.ndarray]) -> list[int]:
        blocks: set[int] = set()
        for x in spans:
            blocks.update(range(max(0, int(x[0]) - spec.min_words) // spec.block, (int(x[-1]) + spec.k + spec.min_words - 1) // spec.block + 1))
        return sorted(blocks)

    def close(cols) -> dict | None:
        pair, (at, dt, alike) = cols[:4], cols[4:]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in pair], axis=0)) + 1
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        keep = (stop - start >= spec.min_seeds) | np.logical_or.reduceat(alike, start)
        out = {n: [] for n in CHAINS.names}
        for s, e in zip(start[keep], stop[keep]):
            x, y = spread(at[s:e].astype(np.int64), dt[s:e].astype(np.int64), alike[s:e], spec)
            whole = [(x[c], y[c]) for c in chains(x, y, spec)]
            if alike[s:e].any():
                whole += straight(at[s:e].astype(np.int64), dt[s:e].astype(np.int64), alike[s:e], whole, spec)
            if whole:
                for n, x in zip(PAIR, pair):
                    out[n].append(x[s])
                u, v = zip(*whole)
                out["size"].append([len(x) for x in u]), out["ba"].append(blocks_of(u)), out["bd"].append(blocks_of(v))
                out["pa"].append(np.concatenate(u)), out["pd"].append(np.concatenate(v))
        return out

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            tail = int(np.flatnonzero(np.any([x != x[-1] for x in cols[:4]], axis=0)).max(initial=-1)) + 1      # the last pair may go on
            held = [c[tail:] for c in cols]
            if tail:
                yield batch_of(close([c[:tail] for c in cols]), CHAINS)
        if held is not None and len(held[0]):
            yield batch_of(close(held), CHAINS)
    return (found.repartition("a", "d").sortWithinPartitions(*PAIR, "pd", "pa").select(*PAIR, "pa", "pd", "alike")
            .mapInArrow(run, "a bigint, a_twin bigint, d bigint, d_twin bigint, size array<int>, ba array<int>, bd array<int>, pa array<int>, pd array<int>"))


def word_blocks(docs: DataFrame, spec: ChainSpec) -> DataFrame:
    """doc, twin, block, words: 32-bit word hashes of every text, ``block`` words a row."""
    schema = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("block", pa.int32()), ("words", pa.binary())])

    def run(batches):
        for b in batches:
            out = {n: [] for n in schema.names}
            for doc, twin, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                raw = word_hashes(as_bytes(text.as_py()).lower()).astype(np.uint32).tobytes()
                for k in range(0, len(raw), 4 * spec.block):
                    out["doc"].append(doc), out["twin"].append(twin), out["block"].append(k // (4 * spec.block)), out["words"].append(raw[k:k + 4 * spec.block])
            yield batch_of(out, schema)
    return docs.select("doc_id", "text", "twin").mapInArrow(run, "doc bigint, twin bigint, block int, words binary")


def leading(same: np.ndarray) -> int:
    """How many true values ``same`` begins with."""
    n = int(same.argmin()) if len(same) else 0
    return len(same) if len(same) and same[n] else n


def align(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(x start, y start, runs) of the alignment through the seeds at px, py: word by word where both
    sides are equally far, else from both ends of the gap; the ends are extended while words agree.
    A run has (x words, y words, 1 if they agree, else 0)."""
    runs: list[tuple[int, int, int]] = []

    def compare(u, v):
        if len(u):
            same = u == v
            if same.all():
                runs.append((len(u), len(u), 1))
                return
            edge = [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), len(same)]
            agree = bool(same[0])
            for s, e in zip(edge, edge[1:]):
                runs.append((e - s, e - s, int(agree)))
                agree = not agree

    xs, ys = int(px[0]), int(py[0])
    m = min(xs, ys)
    back = leading((x[xs - m:xs] == y[ys - m:ys])[::-1])
    xs, ys = xs - back, ys - back
    x0, y0 = xs, ys
    shift = px - py
    turn = np.flatnonzero(shift[1:] != shift[:-1])                 # seeds after which the sides are not equally far
    for i in turn.tolist():
        compare(x[x0:px[i]], y[y0:py[i]])
        u, v = x[px[i]:px[i + 1]], y[py[i]:py[i + 1]]
        n = min(len(u), len(v))
        head = leading(u[:n] == v[:n])
        tail = leading((u[::-1][:n] == v[::-1][:n])[:n - head])
        runs += [r for r in ((head, head, 1), (len(u) - head - tail, len(v) - head - tail, 0), (tail, tail, 1)) if r[0] or r[1]]
        x0, y0 = int(px[i + 1]), int(py[i + 1])
    xe, ye = int(px[-1]), int(py[-1])
    m = min(len(x) - xe, len(y) - ye)
    on = leading(x[xe:xe + m] == y[ye:ye + m])
    compare(x[x0:xe + on], y[y0:ye + on])
    return xs, ys, np.array(runs, np.int64).reshape(-1, 3)


def heavy_parts(score: list[float]) -> list[tuple[int, int]]:
    """The maximal parts of positive sum: none can be made heavier by growing or shrinking, and runs of
    positive scores are never split."""
    done, stack, total = [], [], 0.0
    for i, gain in enumerate(score):
        if gain > 0:
            low, high, start = total, total + gain, i
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][0] >= low:
                    j -= 1
                if j < 0:
                    done += stack                     # the sum never was lower: nothing before can still grow
                    stack = [(low, high, start, i + 1)]
                    break
                if stack[j][1] >= high:
                    stack.append((low, high, start, i + 1))
                    break
                low, start = stack[j][0], stack[j][2]
                del stack[j:]
        total += gain
    return [(s, e) for _, _, s, e in done + stack]


def passages(xs: int, runs: np.ndarray, spec: ChainSpec) -> list[tuple[int, int]]:
    """Word ranges (x side) of the repeats in an alignment: all of it where it is alike enough, else its
    heaviest parts, in which every run of equal words is whole."""
    gain = 2 * runs[:, 0] * runs[:, 2] - spec.similarity * (runs[:, 0] + runs[:, 1])
    if gain.sum() >= 0:
        words = int(runs[:, 0].sum())
        return [(xs, xs + words)] if words >= spec.min_words else []
    edge = [xs, *(np.cumsum(runs[:, 0]) + xs).tolist()]
    return [(edge[s], edge[e]) for s, e in heavy_parts(gain.tolist()) if edge[e] - edge[s] >= spec.min_words]


def agreeing(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, most: np.ndarray, step: int, width: int) -> np.ndarray:
    """How many words agree from x[px] and y[py] on in direction ``step``, up to ``most``, at most ``width``."""
    out = np.empty(len(px), np.int64)
    k = np.arange(width) * step
    for i in range(0, len(px), 1 << 13):
        own = slice(i, i + (1 << 13))
        at, to = px[own, None] + k, py[own, None] + k
        at, to = (np.maximum(at, 0), np.maximum(to, 0)) if step < 0 else (np.minimum(at, len(x) - 1), np.minimum(to, len(y) - 1))
        same = x[at] == y[to]
        same &= np.arange(width) < most[own, None]
        out[own] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return out


def placed(pos: np.ndarray, blocks: np.ndarray, size: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words ``pos`` of a text are among its fetched ``blocks``, which lie one after another, and
    where the stretch of adjoining blocks around each begins and ends."""
    i = blocks.searchsorted(pos // block)
    at = i * block + pos % block
    start = np.flatnonzero(blocks[1:] - blocks[:-1] != 1) + 1
    if not len(start):
        return at, np.zeros(len(pos), np.int64), np.full(len(pos), size, np.int64)
    run = start.searchsorted(i, "right")
    edge = np.concatenate([[0], start * block, [size]])
    return at, edge[run], edge[run + 1]


def pair_passages(x: np.ndarray, xb: np.ndarray, y: np.ndarray, yb: np.ndarray, at: np.ndarray, dt: np.ndarray, edge: np.ndarray, spec: ChainSpec) -> list[tuple[int, int]]:
    """Merged word ranges of the later text that repeat the earlier one, from all chains of the pair: x and y
    are the words of blocks xb and yb, chain i is at[edge[i]:edge[i + 1]] and dt likewise.

    Words that agree beyond a chain's ends count up to ``min_words`` on each side. So a chain that is too short
    even with them is no repeat, and one whose surroundings are a known repeat up to there adds nothing;
    both are passed over without an alignment."""
    px, xlo, xhi = placed(dt, xb, len(x), spec.block)
    py, ylo, yhi = placed(at, yb, len(y), spec.block)
    head, tail, more = edge[:-1], edge[1:] - 1, spec.min_words
    left = agreeing(x, y, px[head] - 1, py[head] - 1, np.minimum(px[head] - xlo[head], py[head] - ylo[head]), -1, more)
    right = agreeing(x, y, px[tail], py[tail], np.minimum(xhi[tail] - px[tail], yhi[tail] - py[tail]), 1, spec.k + more)
    words = px[tail] - px[head] + left + right
    open_ = np.flatnonzero(words >= spec.min_words)
    order = open_[np.lexsort((scramble(open_.astype(np.uint64)), -(words[open_] // spec.block)))]      # long ones first, else spread over the text
    starts: list[int] = []
    stops: list[int] = []
    for i in order.tolist():
        s, e = int(head[i]), int(tail[i])
        known = bisect_right(starts, max(0, int(dt[s]) - more)) - 1
        if known >= 0 and stops[known] >= int(dt[e]) + spec.k + more:
            continue
        x0, y0 = max(int(xlo[s]), int(px[s]) - more), max(int(ylo[s]), int(py[s]) - more)
        x1, y1 = min(int(xhi[e]), int(px[e]) + spec.k + more), min(int(yhi[e]), int(py[e]) + spec.k + more)
        xs, _, runs = align(x[x0:x1], y[y0:y1], px[s:e + 1] - x0, py[s:e + 1] - y0)
        for start, stop in passages(xs + int(dt[s]) - int(px[s]) + x0, runs, spec):
            f, t = bisect_left(stops, start), bisect_right(starts, stop)
            if f < t:
                start, stop = min(start, starts[f]), max(stop, stops[t - 1])
            starts[f:t], stops[f:t] = [start], [stop]
    return list(zip(starts, stops))


def repeats(docs: DataFrame, spec: ChainSpec = ChainSpec()) -> DataFrame:
    """doc_id, twin, source_id, start, stop: merged passages (word numbers) that an earlier document has too.
    ``docs`` comes from ``told_apart``. The words of a pair of documents are fetched once for all its chains,
    so one row holds at most two texts as word hashes."""
    found = written(chained(matches(seeds(docs, spec)), spec).withColumn("pair", F.monotonically_increasing_id()), "chains")
    sides = [found.select("pair", F.lit(side).alias("side"), F.col(doc).alias("doc"), F.col(f"{doc}_twin").alias("twin"), F.explode(f"b{doc}").alias("block"))
             for side, doc in ((0, "d"), (1, "a"))]
    ids = written(found.select(F.explode(F.array("a", "d")).alias("doc_id")).distinct(), "chain-docs")
    blocks = word_blocks(docs.join(small_enough(ids, spec.small), "doc_id", "left_semi"), spec)
    fetched = sides[0].unionByName(sides[1]).join(blocks, ["doc", "twin", "block"]).select("pair", "side", "block", "words")
    parts = fetched.groupBy("pair").agg(F.array_sort(F.collect_set(F.struct("side", "block", "words"))).alias("parts"))       # bounded by the two texts
    schema = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("source_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def flat(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
        return col.offsets.to_numpy(), col.values

    def run(batches):
        for b in batches:
            out = {n: [] for n in schema.names}
            a, d, twin = (b.column(n).to_numpy() for n in ("a", "d", "d_twin"))
            (cut, at), (_, dt), (many, size), (edge, got) = (flat(b.column(n)) for n in ("pa", "pd", "size", "parts"))
            at, dt, size = (v.to_numpy().astype(np.int64) for v in (at, dt, size))
            side, block, words = got.field("side").to_numpy(), got.field("block").to_numpy().astype(np.int64), got.field("words")
            byte = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset:words.offset + len(words) + 1]
            every = np.frombuffer(words.buffers()[2], np.uint32)           # blocks of one pair lie one after another
            for i in range(len(a)):
                lo, hi = edge[i], edge[i + 1]
                turn = lo + int(np.searchsorted(side[lo:hi], 1))
                ends = np.concatenate([[0], np.cumsum(size[many[i]:many[i + 1]])])
                for start, stop in pair_passages(every[byte[lo] // 4:byte[turn] // 4], block[lo:turn], every[byte[turn] // 4:byte[hi] // 4], block[turn:hi],
                                                 at[cut[i]:cut[i + 1]], dt[cut[i]:cut[i + 1]], ends, spec):
                    out["doc_id"].append(d[i]), out["twin"].append(twin[i]), out["source_id"].append(a[i]), out["start"].append(start), out["stop"].append(stop)
            yield batch_of(out, schema)
    return found.join(parts, "pair").select("a", "d", "d_twin", "size", "pa", "pd", "parts").mapInArrow(
        run, "doc_id bigint, twin bigint, source_id bigint, start int, stop int")


def repeat_spans(docs: DataFrame, spec: ChainSpec = ChainSpec()) -> DataFrame:
    """doc_id, twin, spans (merged word ranges, ascending), sources: one row per document with repeats. The
    lists are bounded by the document's own seeds. ``docs`` comes from ``told_apart``."""
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))), F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
                              F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(x))))
    return repeats(docs, spec).groupBy("doc_id", "twin").agg(merged.alias("spans"), F.sort_array(F.collect_set("source_id")).alias("sources"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these words and the white space that follows each run."""
    raw = as_bytes(text)
    start, _ = word_spans(raw)
    edge = np.append(start, len(raw))
    keep, at = [], 0
    for s, e in spans:
        if s < len(start):
            keep.append(raw[at:edge[s]])
            at = int(edge[min(e, len(start))])
    return b"".join([*keep, raw[at:]]).decode("utf-8", "replace")
