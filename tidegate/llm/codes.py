"""Product codes of vectors in exact integer arithmetic, by partial Walsh-Hadamard distances.

Components become integers; a vector is cut into equal parts, and every part position has a codebook
that is refined by rounds of assignment and floored means. Parts and entries are padded with zeros to
a power of two P and transformed by the integer Walsh-Hadamard matrix with its rows in sequency order.
The transform multiplies squared distances by P, so squared differences are summed coefficient by
coefficient: an entry whose partial sum exceeds the whole sum of a good entry is out, and what is left
at the end is compared exactly. Smooth parts have most of their energy in the first coefficients.

The codebooks are parts x entries x components numbers, the only state on the driver and in tasks.
Every round is one pass over the vectors: tasks add up sums and counts per entry, Spark adds those.

Defined cases: vectors that are null or hold null or non-finite components are left out; vectors
shorter than the longest are filled up with zeros, as is the longest up to a multiple of ``parts``;
fewer rows than ``entries`` give smaller codebooks; rows that repeat an id are coded one by one, and
where several could start a codebook the smaller vector comes first; a null id comes last; no rows
give no rows. Numbers too large for 64-bit sums are worked on as Python integers; an error or label
error beyond a bigint is null. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.chaining import small_enough
from tidegate.llm.text import batch_of
from tidegate.session import written

ROWS = 2048                # vectors whose parts are compared at a time
FEW = 4                    # pairs are followed one by one once this times their number is that of all
LIMB = 48                  # bits of a sum kept together
LABELS = 100_000           # rows of the label table that may be broadcast
LONG = 2 ** 63


@dataclass(frozen=True)
class CodeSpec:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@lru_cache(64)
def walsh(width: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of the least power of two that holds ``width``, rows by sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def transformed(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` padded with zeros and transformed, coefficients in sequency order."""
    h = walsh(x.shape[1])[:, :x.shape[1]].astype(x.dtype)
    return x @ h.T


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest row of ``book`` for every row of ``x``; ties to the lower index."""
    n, width = x.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype)
    a, b = transformed(x), transformed(book)
    size, left, j = a.shape[1], np.zeros((n, len(book)), x.dtype), 0
    row = entry = None                                                 # pairs that are left, once they are few
    while j < size and row is None:
        left += (a[:, j:j + 1] - b[:, j]) ** 2
        j += 1
        if j < size and j & (j - 1) == 0:                              # after 1, 2, 4, ... coefficients
            bound = ((a - b[left.argmin(axis=1).astype(np.int64)]) ** 2).sum(axis=1, dtype=x.dtype)      # of one whole distance, scaled alike
            fine = left <= bound[:, None]
            if FEW * np.count_nonzero(fine) <= left.size:
                row, entry = np.nonzero(fine)
                left = left[row, entry]
    if row is None:
        best = left.argmin(axis=1).astype(np.int64)                    # the first of equals
        return best, left[np.arange(n), best] // size
    for j in range(j, size):
        left = left + (a[row, j] - b[entry, j]) ** 2
        on = left <= bound[row]
        row, entry, left = row[on], entry[on], left[on]
    order = np.lexsort((entry, left, row)) if x.dtype != object else np.array(
        sorted(range(len(row)), key=lambda i: (row[i], left[i], entry[i])), np.int64)
    first = order[np.unique(row[order], return_index=True)[1]]
    return entry[first].astype(np.int64), left[first] // size


def integers(batch: pa.Array, spec: CodeSpec, dims: int) -> np.ndarray:
    """rows x parts x width integers floor(scale * x); Python integers where 64 bits might not hold the sums."""
    width = -(-dims // spec.parts)
    out = np.zeros((len(batch), spec.parts * width), np.float64)
    sizes = batch.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.repeat(np.arange(len(batch)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = flat
    most = float(np.abs(out).max(initial=0.0)) * spec.scale
    if most < 2.0 ** 40:                                     # 256 * x is exact here, and so is its floor
        whole = np.floor(out * spec.scale).astype(np.int64)
    else:
        whole = np.array([[_exact_floor(v, spec.scale) for v in row] for row in out.tolist()], object).reshape(out.shape)
    return whole.reshape(len(batch), spec.parts, width)


def _exact_floor(v: float, scale: int) -> int:
    n, d = v.as_integer_ratio()
    return n * scale // d


def _fit_type(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as the narrowest numbers that no sum of squares can leave: 32 bits, 64 bits or Python integers."""
    width = walsh(max(x.shape[-1], 1)).shape[0]
    most = max([abs(int(v)) for a in (x, book) if a.size for v in (a.max(), a.min())], default=0)
    far = 8 * width * width * most * most
    kind = np.int32 if far < 2 ** 31 else np.int64 if far < LONG else object
    return x.astype(kind), book.astype(kind)


def _assigned(x: np.ndarray, books: np.ndarray):
    """For blocks of rows: the block's slice, and per part the index and distance of the nearest entry."""
    x, books = _fit_type(x, books)
    for k in range(0, len(x), ROWS):
        yield slice(k, k + ROWS), [nearest_entries(x[k:k + ROWS, p], books[p]) for p in range(x.shape[1])]


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("comp", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())])


def _limbs(value: int) -> list[int]:
    """Digits of base 2 ** LIMB, lowest first; the last carries the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def _sum_round(vectors: DataFrame, books: np.ndarray, spec: CodeSpec, dims: int) -> dict:
    """(part, entry) -> [count, sum of every component] over all vectors; as many rows as the codebooks have numbers."""
    parts, entries, width = books.shape

    def run(batches):
        total: dict = {}
        for b in batches:
            x = integers(b.column(0), spec, dims)
            for block, found in _assigned(x, books):
                for p, (entry, _) in enumerate(found):
                    rows = x[block, p]
                    for e in np.unique(entry):
                        own = rows[entry == e]
                        t = total.setdefault((p, int(e)), [0] * (width + 1))
                        t[0] += len(own)
                        for c, s in enumerate(own.astype(object).sum(axis=0) if x.dtype == object else own.sum(axis=0)):
                            t[c + 1] += int(s)
        rows = [(p, e, c, i, v) for (p, e), t in total.items() for c, s in enumerate(t) for i, v in enumerate(_limbs(s))]
        if rows:
            yield batch_of(dict(zip(SUMS.names, map(list, zip(*rows)))), SUMS)
    parts_of = vectors.select("v").mapInArrow(run, "part int, entry int, comp int, limb int, total bigint")
    sums: dict = {}
    for r in parts_of.groupBy("part", "entry", "comp", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        t = sums.setdefault((r["part"], r["entry"]), [0] * (width + 1))
        t[r["comp"]] += int(r["total"]) << LIMB * r["limb"]
    return sums


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def learn_codebooks(vectors: DataFrame, spec: CodeSpec = CodeSpec()) -> tuple[np.ndarray, int]:
    """Codebooks (parts x entries x width integers) of ``vectors`` (id, v), and the common length."""
    dims = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(spec.entries).select("v").toArrow()
    books = integers(first.column(0).combine_chunks(), spec, dims).transpose(1, 0, 2).astype(object)
    for _ in range(spec.rounds if books.shape[1] else 0):
        for (p, e), (n, *total) in _sum_round(vectors, books, spec, dims).items():
            books[p, e] = [s // n for s in total]
    return books, dims


def encode(vectors: DataFrame, books: np.ndarray, dims: int, spec: CodeSpec = CodeSpec()) -> DataFrame:
    """The rows of ``vectors`` (id, label, v) as id, label, code and error."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches):
        for b in batches:
            codes, errors = [], []
            for _, found in _assigned(integers(b.column(2), spec, dims), books):
                entry = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
                codes.extend(row.tobytes().hex() for row in entry)
                errors.extend(int(s) if s < LONG else None for s in sum(d.astype(object) for _, d in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                             names=["id", "label", "code", "error"])
    return vectors.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.reshape(-1)).encode()).hexdigest()


def compress(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             spec: CodeSpec = CodeSpec()) -> DataFrame:
    """id, code, error, label_error and the digest of the codebooks, for every usable vector.

    Labels are summed before they are shuffled; the sums are broadcast only if there are few."""
    if spec.entries > 256:
        raise ValueError("a code digit holds at most 256 entries")
    vectors = table.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(usable(F.col("v")))
    books, dims = learn_codebooks(vectors, spec)
    coded = written(encode(vectors, books, dims, spec), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when(F.count("error") == F.count("*"), total).try_cast("bigint")
    of_label = coded.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "_label")
    return (coded.join(small_enough(of_label, LABELS), F.col("label").eqNullSafe(F.col("_label")))
            .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))
