"""Nearest neighbours by cosine from randomly rotated one-bit codes.

A unit vector, less the centre of a bounded sample, is rotated at random and stored as the signs of
its components: dim / 8 bytes, its length and its product f with the code. Code product / f estimates
the inner product with any query without bias, and its error is below
eps * sqrt((1 - f^2) / f^2 / (dim - 1)) with a probability that eps sets. A scan keeps, per query,
the k-th best lower bound; only vectors whose upper bound reaches it are scored exactly, in double
precision on the original vectors.

Every row is indexed; queries go in blocks of bounded size, each broadcast to the scan of all codes.
A scan task returns k rows per query of the block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
nor do vectors whose length is not the commonest one (ties: the longer); fewer than k candidates are
all returned; ties go to the smaller id; a null id takes no part; repeated rows are separate
candidates, but a query's own id is never its neighbour; an empty table gives no rows; other columns
are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidegate.session import written


@dataclass(frozen=True)
class AnnSpec:
    k: int = 5
    eps: float = 3.0                  # of the error bound
    centre_rows: int = 4096           # sample for the centre, the first by hash of the id; it moves no result beyond the bounds
    block_bytes: int = 32 << 20       # of one block of queries in double precision
    rows: int = 4096                  # candidates compared with a block at a time
    cells: int = 2 << 20              # query-candidate estimates held at a time
    exact: int = 1 << 20              # numbers of one side of the pairs scored exactly at a time
    seed: int = 11


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array of doubles) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    clean = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    dims = clean.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return clean.where(F.size("vec") == (dims[0]["d"] if dims else 0))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def safe(v: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, so that squares neither overflow nor vanish; cosines stay the same."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def build_index(clean: DataFrame, dim: int, spec: AnnSpec) -> tuple[DataFrame, np.ndarray]:
    """id, vec, code, length, f for every row of ``clean``; and the centre."""
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(spec.centre_rows).select("vec").toPandas()["vec"]
    unit = safe(np.array(sample.tolist(), float).reshape(-1, dim))
    centre = (unit / norms(unit)[:, None]).mean(axis=0) if len(unit) else np.zeros(dim)

    def run(batches):
        turn = rotation(dim, spec.seed)
        for b in batches:
            if b.num_rows:
                v = safe(matrix(b.column("vec")))
                o = (v / norms(v)[:, None] - centre) @ turn.T
                length = norms(o)
                f = np.abs(o).sum(axis=1) / np.sqrt(dim) / np.where(length > 0, length, 1)
                bits = np.packbits(o > 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("vec"), pa.array(list(map(bytes, bits)), pa.binary()), pa.array(length), pa.array(np.where(length > 0, f, 1.0))],
                    names=["id", "vec", "code", "length", "f"])
    return clean.mapInArrow(run, "id bigint, vec array<double>, code binary, length double, f double"), centre


def cosines(q: np.ndarray, qn: np.ndarray, v: np.ndarray, vn: np.ndarray, qi: np.ndarray, vi: np.ndarray, most: int) -> np.ndarray:
    """The cosine of every pair (q[qi], v[vi]) of vectors with lengths qn and vn; at most ``most`` numbers of each side are gathered at a time."""
    out, step = np.empty(len(qi)), max(1, most // q.shape[1])
    for at in range(0, len(qi), step):
        a, b = qi[at:at + step], vi[at:at + step]
        out[at:at + step] = np.einsum("ij,ij->i", q[a], v[b]) / (qn[a] * vn[b])
    return out


def _scan(ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, spec: AnnSpec):
    dim = queries.shape[1]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        turn = rotation(dim, spec.seed)
        q = safe(queries)
        qn = norms(q)
        unit = q / qn[:, None]
        turned, offset = (unit @ turn.T / np.sqrt(dim)).astype(np.float32), unit @ centre
        best = np.full((len(q), spec.k), -np.inf)
        best_id = np.full((len(q), spec.k), np.iinfo(np.int64).max)
        floor = np.full(len(q), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, spec.rows):
                part = b.slice(at, spec.rows)
                vid, length, f = (part.column(c).to_numpy() for c in ("id", "length", "f"))
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(vid), -1)
                signs = (np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1)
                v = safe(matrix(part.column("vec")))
                vn = norms(v)
                scale = length / f
                slack = length * spec.eps * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1)) + 1e-5
                step = max(1, spec.cells // len(vid))
                for s in range(0, len(q), step):
                    own = slice(s, s + step)
                    est = (turned[own] @ signs.T) * scale.astype(np.float32) + offset[own, None].astype(np.float32)
                    est[ids[own, None] == vid[None, :]] = -np.inf
                    low = est - slack.astype(np.float32)
                    if len(vid) > spec.k:
                        kth = np.partition(low, len(vid) - spec.k, axis=1)[:, len(vid) - spec.k]
                    else:
                        kth = np.full(len(est), -np.inf, np.float32)
                    bar = np.maximum(floor[own], kth)
                    qi, vi = np.nonzero((est + slack.astype(np.float32) >= bar[:, None].astype(np.float32) - 1e-6) & (est > -np.inf))
                    if not len(qi):
                        continue
                    score = cosines(q[own], qn[own], v, vn, qi, vi, spec.exact)
                    rows = np.concatenate([np.repeat(np.arange(len(est)), spec.k), qi])
                    all_s = np.concatenate([best[own].ravel(), score])
                    all_i = np.concatenate([best_id[own].ravel(), vid[vi]])
                    order = np.lexsort((all_i, -all_s, rows))
                    first = np.searchsorted(rows[order], np.arange(len(est)))
                    top = order[first[:, None] + np.arange(spec.k)]
                    best[own], best_id[own] = all_s[top], all_i[top]
                    floor[own] = best[own][:, -1]
        qi, k = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(best_id[qi, k]), pa.array(best[qi, k])], schema=schema)
    return run


def nearest(index: DataFrame, centre: np.ndarray, queries: DataFrame, spec: AnnSpec = AnnSpec()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query (id, vec). The query list is read
    once per block; a block is bounded by ``block_bytes``, and so is what is broadcast."""
    dim = len(centre)
    per = max(1, spec.block_bytes // (8 * max(dim, 1)))
    blocks = max(1, -(-queries.count() // per))
    top = None
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select("id", "vec").orderBy("id").toArrow()
        if not own.num_rows:
            continue
        ids, vecs = own["id"].to_numpy(), np.concatenate([matrix(c) for c in own["vec"].chunks])
        found = index.mapInArrow(_scan(ids, vecs, centre, spec), "query_id bigint, vec_id bigint, score double")
        top = found if top is None else top.unionByName(found)
    if top is None:
        top = index.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")              # k rows per query and scan task
    return top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, spec: AnnSpec = AnnSpec()) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``."""
    clean = written(usable(vectors, id_col, vec_col), "vectors")
    first = clean.limit(1).collect()
    index, centre = build_index(clean, len(first[0]["vec"]) if first else 1, spec)
    index = written(index, "codes")
    return nearest(index, centre, index.where(F.col("id") % every == 0).dropDuplicates(["id"]), spec)
