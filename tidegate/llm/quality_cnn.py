"""Quality classifier: a convolution over the bytes of whole texts, in numpy.

A text is read in overlapping chunks. ``filters`` learned filters of ``width`` bytes move over a
chunk in steps of ``stride``; each keeps its largest answer in the chunk. A document's vector is the
largest and the mean answer of every filter over all its chunks; a logistic layer makes one
probability of it. The filters are tables byte -> answer per position, which is a convolution over
one-hot bytes, so a chunk costs a few gathers and sums and texts of any length run in bounded memory.

Defined cases: a null or empty text is scored as an all-zero vector; labels that are null or rows
without a label are not learned from; without labels of both classes every score is the share of
good labels (one half without labels); repeated rows count as often as they appear; other columns
are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.text import as_bytes


@dataclass(frozen=True)
class CnnSpec:
    filters: int = 16
    width: int = 6
    stride: int = 2
    chunk: int = 1024
    overlap: int = 64
    sample_rows: int = 3000        # labelled documents learned from, the first by hash of doc_id
    sample_bytes: int = 16_384     # longer documents are not in the sample (they are scored whole)
    epochs: int = 12
    rate: float = 0.02
    decay: float = 1e-4
    folds: int = 5
    seed: int = 3


@dataclass
class Model:
    table: np.ndarray              # (width, 256, filters)
    bias: np.ndarray
    dense: np.ndarray              # (2 * filters + 1,)
    spec: CnnSpec


def padded(raw: bytes, spec: CnnSpec) -> np.ndarray:
    """The bytes of a text, filled up with zeros until windows of ``width`` at steps of ``stride`` read every one."""
    short = spec.width - len(raw)
    return np.frombuffer(raw + bytes(short if short > 0 else short % spec.stride), np.uint8)


def chunk_answers(raw: bytes, table: np.ndarray, bias: np.ndarray, spec: CnnSpec) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk and filter the largest answer and the byte where it starts. Positions are shared by
    overlapping chunks, so each is computed once per piece of the text."""
    b = padded(raw, spec)
    hop = spec.chunk - spec.overlap
    tops, wheres = [], []
    step = 64 * hop                                              # chunks are made 64 at a time
    for at in range(0, max(1, len(b) - spec.overlap), step):
        part = b[at:at + step + spec.overlap]
        if len(part) < spec.width:
            continue
        n = (len(part) - spec.width) // spec.stride + 1
        z = table[0][part[0:n * spec.stride:spec.stride]]
        for k in range(1, spec.width):
            z += table[k][part[k:k + n * spec.stride:spec.stride]]
        starts = np.arange(0, max(1, len(part) - spec.overlap), hop) // spec.stride
        long = (spec.chunk - spec.width) // spec.stride + 1
        for s in starts:
            own = z[s:s + long]
            if len(own):
                w = own.argmax(axis=0)
                tops.append(own[w, np.arange(own.shape[1])])
                wheres.append(at + (s + w) * spec.stride)
    return np.maximum(np.array(tops) + bias, 0), np.array(wheres)


def document_vector(raw: bytes, m: Model) -> np.ndarray:
    if not raw:
        return np.zeros(2 * m.spec.filters + 1)
    top, _ = chunk_answers(raw, m.table, m.bias, m.spec)
    return np.concatenate([top.max(axis=0), top.mean(axis=0), [1.0]])


def probability(vectors: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(vectors @ m.dense, -30, 30)))


def constant(share: float, spec: CnnSpec) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    dense = np.zeros(2 * spec.filters + 1)
    dense[-1] = np.log(share / (1 - share))
    return Model(np.zeros((spec.width, 256, spec.filters), np.float32), np.zeros(spec.filters, np.float32), dense, spec)


def fit(texts: list[bytes], good: np.ndarray, spec: CnnSpec = CnnSpec()) -> Model:
    """Gradient descent (Adam) document by document batch; only the winning positions get a gradient.
    Classes weigh the same while the filters are learned; the last step fits the true shares."""
    rng = np.random.default_rng(spec.seed)
    texts, good = [t for t in texts if t], good[np.array([bool(t) for t in texts], bool)] if len(texts) else good
    if not len(texts) or good.all() or not good.any():
        return constant(float(good.mean()) if len(good) else 0.5, spec)
    m = Model((rng.standard_normal((spec.width, 256, spec.filters)) * 0.15).astype(np.float32),
              np.zeros(spec.filters, np.float32), np.concatenate([rng.standard_normal(2 * spec.filters) * 0.1, [0.0]]), spec)
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    moments = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)] for p in (m.table, m.bias, m.dense)]
    t = 0
    for epoch in range(spec.epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            grads = [np.zeros_like(p, dtype=np.float64) for p in (m.table, m.bias, m.dense)]
            own = order[lo:lo + 32]
            for i in own:
                _accumulate(texts[i], float(good[i]), weight[i] / len(own), m, grads)
            t += 1
            rate = spec.rate * 0.5 * (1 + np.cos(np.pi * epoch / spec.epochs))
            for p, g, (a, b) in zip((m.table, m.bias, m.dense), grads, moments):
                g += spec.decay * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)).astype(p.dtype)
    x = np.array([document_vector(d, m) for d in texts])
    y = good.astype(float)
    for _ in range(30):                                         # Newton steps of the ridge logistic layer
        p = probability(x, m)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * m.dense)
        m.dense = m.dense + move
        if np.abs(move).max() < 1e-6:
            break
    return m


def _accumulate(raw: bytes, y: float, weight: float, m: Model, grads: list[np.ndarray]) -> None:
    spec = m.spec
    top, where = chunk_answers(raw, m.table, m.bias, spec)
    v = np.concatenate([top.max(axis=0), top.mean(axis=0), [1.0]])
    e = (float(probability(v[None], m)[0]) - y) * weight
    grads[2] += e * v
    g = np.repeat(m.dense[None, spec.filters:2 * spec.filters] / len(top), len(top), axis=0)
    g[top.argmax(axis=0), np.arange(spec.filters)] += m.dense[:spec.filters]
    g = np.where(top > 0, g * e, 0)
    grads[1] += g.sum(axis=0)
    b = padded(raw, spec)
    f = np.broadcast_to(np.arange(spec.filters), where.shape)
    for k in range(spec.width):
        np.add.at(grads[0][k], (b[where + k], f), g)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, spec: CnnSpec = CnnSpec()) -> Model:
    """Learn from a bounded sample of the labelled documents outside the held-out fold."""
    first = F.md5(F.col("doc_id").cast("string"))
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), spec.folds))
              .select("doc_id", F.col("quality").alias("q")).orderBy(first, "q").limit(spec.sample_rows))        # bounded: may be broadcast
    got = (docs.select("doc_id", "text").where(F.octet_length("text") <= spec.sample_bytes).join(F.broadcast(marked), "doc_id")
           .orderBy(first, "q", "text").limit(spec.sample_rows).toArrow())
    return fit([as_bytes(t.as_py()) for t in got["text"]], got["q"].to_numpy() == 1, spec)


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, score of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            x = np.array([document_vector(as_bytes(t.as_py()), m) for t in b.column(1)]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probability(x, m) if b.num_rows else np.empty(0))], schema=schema)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
