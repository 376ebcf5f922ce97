"""Exact repeated byte strings across documents, by deep-shallow sorting of suffixes.

Every ``length``-byte string belongs to the smallest hash of its ``k``-byte substrings, so equal
strings meet in one bucket. Neighbouring strings of a document with the same smallest hash travel as
one stretch of bytes; a chunk of documents sends the stretches of a bucket in one compressed block,
equal ones once. In a bucket, stretches whose hash occurs in one document only are set aside, equal
stretches are collapsed, strings that the smallest document of the hash has at the same distance from
it are settled by comparing the two, and the suffixes of the rest are ordered: multikey quicksort, eight bytes a
step, down to a shallow depth; groups that still agree there, and so share a long prefix, are finished
by a blind trie (a group of two is the trie of one comparison). Suffixes that agree over ``length``
bytes are repeats in every document but the smallest.

Defined cases: a null text is empty; rows with a null doc_id take no part and keep their bytes; rows
that repeat doc_id and text are one document, rows of one doc_id with different texts are documents of their own of
which none is earlier than the other; an empty table gives no rows; other columns are ignored; texts
of any length are read in pieces of ``chunk`` bytes.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidegate.llm.chaining import _BYTE, _powers, scramble
from tidegate.llm.text import as_bytes, batch_of, small_enough, told_apart
from tidegate.session import written


@dataclass(frozen=True)
class SuffixSpec:
    length: int = 50
    k: int = 16
    shallow: int = 24               # bytes ordered by multikey quicksort; a multiple of 8 below ``length``
    chunk: int = 1 << 20            # bytes of text handled at a time
    stretch: int = 256              # strings of one stretch, at most
    bucket_bytes: int = 6 << 20     # of input per bucket
    least_buckets: int = 48
    small: int = 200_000            # rows of a table that may be broadcast


def _substring_hashes(b: np.ndarray, spec: SuffixSpec) -> np.ndarray:
    raw = b.tobytes() + bytes(8)
    eight = np.ndarray((len(b) + 1,), "<u8", raw, strides=(1,))
    n = len(b) - spec.k + 1
    h = np.zeros(n, np.uint64)
    for at in [*range(0, spec.k - 8, 8), spec.k - 8]:
        h = h * np.uint64(0x2545F4914F6CDD1D) + eight[at:at + n]
        h ^= h >> np.uint64(29)
    return scramble(h)


def smallest_hashes(b: np.ndarray, spec: SuffixSpec) -> np.ndarray:
    """For every string start the smallest substring hash inside the string."""
    h = _substring_hashes(b, spec)
    width, have = spec.length - spec.k + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[:len(h) - (width - have)], h[width - have:]) if have < width else h


def stretches(b: np.ndarray, bounds: np.ndarray, spec: SuffixSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, hash) of the stretches of texts b[bounds[i]:bounds[i + 1]]."""
    if len(b) < spec.length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    low = smallest_hashes(b, spec)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = owner[:len(low)] == owner[spec.length - 1:]                     # strings inside one text
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:len(low)] != owner[:len(low) - 1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(low)))
    keep = whole[start]
    start, count = start[keep], count[keep]
    if (count > spec.stretch).any():                                        # long runs of one hash are cut: strings do not depend on each other
        parts = -(-count // spec.stretch)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + at * spec.stretch, np.minimum(np.repeat(count, parts) - at * spec.stretch, spec.stretch)
    return start, count, scramble(low[start] + np.uint64(1))


def content_hashes(b: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """A hash of the bytes of every stretch; ``start`` ascends, and ``step`` bytes are held at a time."""
    out, i = np.empty(len(start), np.uint64), 0
    stop = start + size
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + step, "right")))
        part = b[start[i]:stop[j - 1]]
        up, down = _powers(len(part) + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[:len(part)], dtype=np.uint64)])
        at = start[i:j] - start[i]
        out[i:j] = scramble((run[at + size[i:j]] - run[at]) * down[at] + size[i:j].astype(np.uint64))
        i = j
    return out


def gathered(b: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The bytes b[start:start + size] of every stretch, one after the other."""
    parts = [np.empty(0, np.uint8)]
    for i in range(0, len(start), step):
        x, n = start[i:i + step], size[i:i + step]
        stop = np.cumsum(n)
        parts.append(b[np.arange(int(stop[-1])) + np.repeat(x - stop + n, n)])
    return np.concatenate(parts)


def collapse(b: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per stretch the index of the first of those with equal bytes, in order of (doc, pos). Equal
    hashes are confirmed on the bytes; a stretch that only shares its hash stands for itself."""
    h = content_hashes(b, start, size)
    order = np.lexsort((pos, doc, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    lead = np.empty(len(h), np.int64)
    lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = np.flatnonzero(lead != np.arange(len(h)))
    if len(other):
        same = size[other] == size[lead[other]]
        other, off = other[same], other[~same]
        lead[off] = off
        if len(other):
            equal = gathered(b, start[other], size[other]) == gathered(b, start[lead[other]], size[other])
            good = np.logical_and.reduceat(equal, np.cumsum(size[other]) - size[other])
            lead[other[~good]] = other[~good]
    return lead, order


class BlindTrie:
    """Strings of one length in order; inner nodes keep a depth only and skip what all below share."""

    def __init__(self):
        self.root = None

    @staticmethod
    def shared(a: bytes, b: bytes) -> int:
        x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        return len(a) - (x.bit_length() + 7) // 8

    def add(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = (s, [item])
            return
        node = self.root
        while len(node) == 3:                                   # blind: only the branching bytes are looked at
            node = node[1].get(s[node[0]]) or node[2]
        if node[0] == s:
            node[1].append(item)
            return
        at, leaf = self.shared(s, node[0]), (s, [item])
        above, here = None, self.root
        while len(here) == 3 and here[0] < at:
            above, here = here, here[1][s[here[0]]]
        if len(here) == 3 and here[0] == at:
            here[1][s[at]] = leaf
            return
        inner = (at, {node[0][at]: here, s[at]: leaf}, node)
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner

    def leaves(self):
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 2:
                yield node
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]


def equal_strings(b: np.ndarray, start: np.ndarray, group: np.ndarray, doc: np.ndarray, spec: SuffixSpec) -> np.ndarray:
    """Per string b[start:start + length] the smallest doc that has it. ``group`` is equal where
    strings may be."""
    least = doc.copy()
    raw = b.tobytes() + bytes(8)
    digits = np.ndarray((len(b) + 1,), ">u8", raw, strides=(1,))
    which, name = np.arange(len(start)), group
    for depth in [*range(0, spec.shallow, 8)]:                              # shallow: multikey quicksort, eight bytes a key
        key = digits[start[which] + depth].astype(np.uint64)
        order = np.lexsort((key, name))
        which, key, name = which[order], key[order], name[order]
        new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))[:len(which)]
        name = np.cumsum(new)
        several = np.bincount(name)[name] > 1
        which, name = which[several], name[several]
        if not len(which):
            return least
    first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    size = np.diff(np.append(first, len(which)))
    rest = spec.length - spec.shallow
    two = first[size == 2]
    x, y = which[two], which[two + 1]
    same = np.ones(len(two), bool)
    for at in [*range(spec.shallow, spec.length - 8, 8), spec.length - 8]:
        same &= digits[start[x] + at] == digits[start[y] + at]
    low = np.minimum(doc[x], doc[y])[same]
    least[x[same]], least[y[same]] = low, low
    for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):       # deep: blind tries
        trie = BlindTrie()
        for i, s in zip(which[f:f + n].tolist(), (start[which[f:f + n]] + spec.shallow).tolist()):
            trie.add(raw[s:s + rest], i)
        for _, items in trie.leaves():
            if len(items) > 1:
                least[items] = doc[items].min()
    return least


def _agree(b: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int, width: int) -> np.ndarray:
    """How many bytes agree from x and y on, in direction ``step``, up to ``most``."""
    out = np.empty(len(x), np.int64)
    k = np.arange(width) * step
    for i in range(0, len(x), 1 << 13):
        own = slice(i, i + (1 << 13))
        same = b[np.clip(x[own, None] + k, 0, len(b) - 1)] == b[np.clip(y[own, None] + k, 0, len(b) - 1)]
        same &= np.arange(width) < most[own, None]
        out[own] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return out


def against_head(b, start, size, doc, reps, head, spec: SuffixSpec) -> tuple[np.ndarray, np.ndarray]:
    """Per stretch the range of strings that the head of its group has around the common hash; empty
    for the head itself and for stretches of the head's document."""
    width = spec.length - spec.k + 1
    raw = b.tobytes() + bytes(8)
    place = np.zeros(len(start), np.int64)
    who = np.unique(np.concatenate([reps, head]))
    for i in range(0, len(who), 1 << 13):
        own = who[i:i + (1 << 13)]
        first = np.frombuffer(raw, np.uint8)[start[own, None] + np.arange(spec.length)]
        place[own] = _substring_hashes(first.ravel(), spec)[np.arange(len(own))[:, None] * spec.length + np.arange(width)].argmin(axis=1)
    lo, hi = np.zeros(len(reps), np.int64), np.zeros(len(reps), np.int64)
    use = np.flatnonzero((reps != head) & (doc[reps] > doc[head]))
    r, h = reps[use], head[use]
    mr, mh = place[r], place[h]
    left = _agree(b, start[r] + mr - 1, start[h] + mh - 1, np.minimum(mr, mh), -1, spec.length)
    right = _agree(b, start[r] + mr, start[h] + mh, np.minimum(size[r] - mr, size[h] - mh), 1, spec.length)
    lo[use] = mr - left
    hi[use] = np.maximum(np.minimum(size[r] - spec.length, mr + right - spec.length) + 1, lo[use])
    none = hi <= lo
    lo[none] = hi[none] = 0
    return lo, hi


ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _packed(doc, twin, pos, size, tag, content) -> bytes:
    head = np.array([len(doc)], "<i8").tobytes()
    tag = tag.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()          # three bytes of the hash tell most groups apart
    planes = [x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes() for x, kind in ((doc, "<i8"), (twin, "<i8"), (pos, "<i8"), (size, "<i4"))]      # equal high bytes side by side
    return zstandard.ZstdCompressor(level=5).compress(b"".join([head, *planes, tag, content.tobytes()]))


def _unpacked(block: bytes):
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8, []
    for kind, width in (("<i8", 8), ("<i8", 8), ("<i8", 8), ("<i4", 4)):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel().astype(np.int64))
        at += n * width
    tag = np.zeros((n, 4), np.uint8)
    tag[:, :3] = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(3, n).T
    return (*out, tag.view("<u4").ravel().astype(np.int64), np.frombuffer(raw, np.uint8, -1, at + 3 * n))


def _chunks(batches, spec: SuffixSpec):
    """Lists of (doc, twin, offset, bytes) of about ``chunk`` bytes; a longer text comes in overlapping pieces
    whose string starts do not overlap."""
    held, size = [], 0
    for b in batches:
        for doc, twin, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
            raw = as_bytes(text.as_py())
            for at in range(0, max(1, len(raw) - spec.length + 1), spec.chunk):
                part = raw[at:at + spec.chunk + spec.length - 1]
                if len(part) >= spec.length:
                    held.append((doc, twin, at, part))
                    size += len(part)
                if size >= spec.chunk:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def blocks(docs: DataFrame, buckets: int, spec: SuffixSpec) -> DataFrame:
    """bucket, block: the stretches of every chunk, dealt by hash; what is settled inside the chunk
    goes along as a block of plain spans."""
    def run(batches):
        for chunk in _chunks(batches, spec):
            b = np.frombuffer(b"".join(p for *_, p in chunk), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(p) for *_, p in chunk])])
            start, count, h = stretches(b, bounds, spec)
            text = np.searchsorted(bounds, start, "right") - 1
            doc, twin, offset = (np.array([c[i] for c in chunk], np.int64)[text] for i in range(3))
            pos = start - bounds[text] + offset
            size = count + spec.length - 1
            lead, _ = collapse(b, start, size, doc, pos)
            settled = doc > doc[lead]                                        # an equal stretch of a smaller document is in this chunk
            out = {"bucket": [], "block": []}
            if settled.any():
                out["bucket"].append(int(bounds[-1] + chunk[0][0]) % buckets)
                out["block"].append(b"\0" + np.stack([doc[settled], twin[settled], pos[settled], (pos + size)[settled]]).astype("<i8").tobytes())
            left = np.flatnonzero(~settled)
            to = (h[left] % np.uint64(buckets)).astype(np.int64)
            left = left[np.argsort(to, kind="stable")]
            edge = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=buckets))])
            tag = (h >> np.uint64(32)).astype(np.uint32)
            for i in np.flatnonzero(np.diff(edge)):
                own = left[edge[i]:edge[i + 1]]
                out["bucket"].append(int(i))
                out["block"].append(b"\1" + _packed(doc[own], twin[own], pos[own], size[own], tag[own], gathered(b, start[own], size[own])))
            yield batch_of(out, ROWS)
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", "twin").mapInArrow(run, "bucket int, block binary")


def bucket_spans(raw_blocks: list[bytes], spec: SuffixSpec) -> tuple[np.ndarray, ...]:
    """(doc, twin, start, stop) of the bytes that repeat a smaller document, from the blocks of one bucket."""
    spans = [np.frombuffer(x, "<i8", -1, 1).reshape(4, -1) for x in raw_blocks if x[:1] == b"\0"]
    parts = [_unpacked(x[1:]) for x in raw_blocks if x[:1] == b"\1"]
    if parts:
        doc, twin, pos, size, tag, b = (np.concatenate(x) for x in zip(*parts))
        start = np.cumsum(size) - size
        order = np.lexsort((doc, tag))
        first = np.append(True, tag[order][1:] != tag[order][:-1])
        group = np.cumsum(first) - 1
        low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group, doc[order])
        np.maximum.at(high, group, doc[order])
        use = np.sort(order[(low < high)[group]])                            # the hash occurs in several documents
        doc, twin, pos, size, tag = doc[use], twin[use], pos[use], size[use], tag[use]
        if len(use):
            b = gathered(b, start[use], size)
            start = np.cumsum(size) - size
            lead, _ = collapse(b, start, size, doc, pos)
            settled = doc > doc[lead]
            spans.append(np.stack([doc[settled], twin[settled], pos[settled], (pos + size)[settled]]))
            reps = np.flatnonzero(lead == np.arange(len(lead)))
            reps = reps[np.lexsort((pos[reps], doc[reps], tag[reps]))]
            group = np.cumsum(np.append(True, tag[reps][1:] != tag[reps][:-1])) - 1
            head = reps[np.flatnonzero(np.append(True, group[1:] != group[:-1]))][group]            # the group's smallest
            lo, hi = against_head(b, start, size, doc, reps, head, spec)                              # strings lo .. hi - 1 are settled
            n = size[reps] - spec.length + 1
            open_ = (reps != head) & (hi - lo < n)
            wanted = np.bincount(group, weights=open_)[group] > 0
            cut = hi > lo
            run = [(reps[cut], lo[cut], hi[cut] + spec.length - 1)]
            owner = np.concatenate([reps[wanted], reps[wanted]])                                      # the strings before and after the settled ones
            first = np.concatenate([np.zeros(int(wanted.sum()), np.int64), hi[wanted]])
            many = np.concatenate([lo[wanted], (n - hi)[wanted]])
            owner, first, many = owner[many > 0], first[many > 0], many[many > 0]
            if len(owner):
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                owner = np.repeat(owner, many)
                hit = equal_strings(b, start[owner] + at, tag[owner], doc[owner], spec) < doc[owner]
                new = np.append(True, (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(hit)) - 1
                s, e = s[hit[s]], e[hit[s]]
                run.append((owner[s], at[s], at[e] + spec.length))
            run = [np.concatenate(x) for x in zip(*run)]
            spans.append(np.stack([doc[run[0]], twin[run[0]], pos[run[0]] + run[1], pos[run[0]] + run[2]]))
            if len(run[0]):
                same = np.flatnonzero((lead != np.arange(len(lead))) & ~settled)              # equal stretches of the same document share its runs
                if len(same):
                    by = np.argsort(run[0], kind="stable")
                    lo, hi = np.searchsorted(run[0][by], lead[same], "left"), np.searchsorted(run[0][by], lead[same], "right")
                    k = same[np.repeat(np.arange(len(same)), hi - lo)]
                    r = by[np.arange(len(k)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
                    spans.append(np.stack([doc[k], twin[k], pos[k] + run[1][r], pos[k] + run[2][r]]))
    return tuple(np.concatenate(x) for x in zip(*spans)) if spans else (np.empty(0, np.int64),) * 4


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges made one, in order."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, s[1:] > e[:-1])
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def repeated_spans(docs: DataFrame, spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """doc_id, twin, spans: merged byte ranges that repeat a string of a smaller document; one row per
    document that has any. ``docs`` comes from ``told_apart``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(spec.least_buckets, -(-total // spec.bucket_bytes))

    def settle(t: pa.Table) -> pa.Table:
        doc, twin, start, stop = bucket_spans(t["block"].to_pylist(), spec)
        return pa.Table.from_batches([batch_of({"doc_id": doc, "twin": twin, "start": start, "stop": stop}, SPANS)])

    found = blocks(docs, buckets, spec).groupBy("bucket").applyInArrow(settle, "doc_id bigint, twin bigint, start bigint, stop bigint")
    lists = found.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))          # bounded by the document's own length
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def tidy(batches):
        for b in batches:
            flat = b.column(2).flatten()
            edge = b.column(2).offsets.to_numpy()
            s, e = (flat.field(i).to_numpy() for i in range(2))
            rows = []
            for lo, hi in zip(edge[:-1] - edge[0], edge[1:] - edge[0]):
                x, y = merged(s[lo:hi], e[lo:hi])
                rows.append([{"start": i, "stop": j} for i, j in zip(x.tolist(), y.tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, kind)], names=["doc_id", "twin", "spans"])
    return lists.mapInArrow(tidy, "doc_id bigint, twin bigint, spans array<struct<start:bigint,stop:bigint>>")


def dedup_bytes(docs: DataFrame, spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """doc_id, n_bytes, spans, kept (the remaining bytes) of every document."""
    docs = told_apart(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    spans = written(repeated_spans(docs, spec), "byte-spans")
    own = docs.join(small_enough(spans, spec.small), ["doc_id", "twin"], "left")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in batches:
            sizes, kept, found = [], [], []
            for text, spans_ in zip(b.column(1), b.column(2)):
                raw, cut = as_bytes(text.as_py()), spans_.as_py() or []
                parts, at = [], 0
                for s in cut:
                    parts.append(raw[at:s["start"]])
                    at = s["stop"]
                sizes.append(len(raw)), kept.append(b"".join([*parts, raw[at:]])), found.append(cut)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "spans", "kept"])
    return own.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
