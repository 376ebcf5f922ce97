"""A regression perceptron with one hidden layer, trained for many models at once by summed gradients.

Spark ML has no neural regressor. Every step is one pass: a task adds up the gradient of the squared loss
of its rows for every model at that model's weights and emits one row a model; the rows are
added in a tree on the executors, and the driver, which holds only the weights, moves them by Adam. A step
sees one of several hash parts of the rows, or all of them when there are few; the rows are packed by part once, so a
step reads its own part only. Targets are standardised
with training moments, so the step size suits any unit.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegate import constants as K
from tidegate.plans.logistic import OUT, _emit, _totals


PACK_BYTES = 16 << 20                 # numbers of all parts that a task holds before it emits blocks


@dataclass(frozen=True)
class NetSpec:
    hidden: int = 64
    steps: int = 300
    rate: float = 0.02
    decay: float = 1e-4               # L2 on weights, a row's share
    batch_rows: int = 200_000         # rows of a step; more rows are cut into parts by hash
    tolerance: float = 1e-5           # of the loss over ``patience`` steps of a whole pass
    patience: int = 10
    seed: int = K.RANDOM_STATE


@dataclass
class Net:
    w1: np.ndarray                    # inputs x hidden
    b1: np.ndarray
    w2: np.ndarray                    # hidden
    b2: float
    centre: float = 0.0               # of the target
    width: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0.0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.hidden(x) @ self.w2 + self.b2) * self.width + self.centre

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w1.ravel(), self.b1, self.w2, [self.b2]])

    def moved(self, flat: np.ndarray) -> "Net":
        d, h = self.w1.shape
        return Net(flat[:d * h].reshape(d, h), flat[d * h:d * h + h], flat[d * h + h:d * h + 2 * h], float(flat[-1]), self.centre, self.width)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows, sum of squared errors / 2 and its gradient, for targets in their own unit."""
        h = self.hidden(x)
        off = h @ self.w2 + self.b2 - (y - self.centre) / self.width
        back = np.outer(off, self.w2) * (h > 0)
        return np.concatenate([[len(y), 0.5 * off @ off], (x.T @ back).ravel(), back.sum(axis=0), h.T @ off, [off.sum()]])

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @staticmethod
    def from_json(text: str) -> "Net":
        return Net(**{k: np.array(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})


def start(inputs: int, spec: NetSpec, model: int = 0) -> Net:
    rng = np.random.default_rng([spec.seed, model])
    reach = np.sqrt(6.0 / (inputs + spec.hidden)), np.sqrt(6.0 / (spec.hidden + 1))
    return Net(rng.uniform(-reach[0], reach[0], (inputs, spec.hidden)), np.zeros(spec.hidden), rng.uniform(-reach[1], reach[1], spec.hidden), 0.0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


BLOCKS = pa.schema([("model", pa.int32()), ("part", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])


def _pack(batches):
    """Rows (model, v, y, part) as blocks: the numbers of all rows of a model and part that are held, as bytes."""
    held: dict[tuple[int, int], list] = {}
    size = 0

    def blocks():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[
            (m, p, b"".join(x), b"".join(y)) for (m, p), (x, y) in sorted(held.items())]), BLOCKS)], schema=BLOCKS)
    for b in batches:
        if not b.num_rows:
            continue
        of, y, part = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
        x = _matrix(b, "v").reshape(b.num_rows, -1)
        order = np.lexsort((part, of))
        for own in np.split(order, np.flatnonzero((np.diff(part[order]) != 0) | (np.diff(of[order]) != 0)) + 1):
            xs, ys = held.setdefault((int(of[own[0]]), int(part[own[0]])), ([], []))
            xs.append(x[own].tobytes()), ys.append(y[own].tobytes())
        size += x.nbytes + y.nbytes
        if size >= PACK_BYTES:
            yield blocks()
            held, size = {}, 0
    if held:
        yield blocks()


def _gradients(nets: dict[int, Net]):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for m, xs, ys in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                y = np.frombuffer(ys.as_buffer(), np.float64)
                x = np.frombuffer(xs.as_buffer(), np.float64).reshape(len(y), -1)
                g = nets[m].gradient(x[:, :nets[m].w1.shape[0]], y)
                total[m] = total[m] + g if m in total else g
        for m, g in total.items():
            yield _emit([m], g[None])
    return run


class Adam:
    def __init__(self, size: int, rate: float):
        self.first, self.second, self.rate, self.step = np.zeros(size), np.zeros(size), rate, 0

    def move(self, at: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.999 * self.second + 0.001 * slope ** 2
        return at - self.rate * (self.first / (1 - 0.9 ** self.step)) / (np.sqrt(self.second / (1 - 0.999 ** self.step)) + 1e-8)


def fit_nets(rows: DataFrame, inputs: dict[int, int], spec: NetSpec = NetSpec()) -> dict[int, Net]:
    """One net per model of ``rows`` (model, v, y), training rows only; ``inputs`` gives each model's width.

    A model whose loss no longer falls is done and takes no part in later passes."""
    rows = rows.select(F.col("model").cast("int").alias("model"), "v", F.col("y").cast("double").alias("y")).persist()
    packed = None
    try:
        facts = {r["model"]: r for r in rows.groupBy("model").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).collect()}
        nets = {m: start(d, spec, m) for m, d in inputs.items()}
        for m, r in facts.items():
            nets[m].centre, nets[m].width = r["m"], r["s"] or 1.0
        parts = max(1, -(-max((r["n"] for r in facts.values()), default=0) // spec.batch_rows))
        adam = {m: Adam(len(n.flat()), spec.rate) for m, n in nets.items()}
        losses: dict[int, list[float]] = {m: [] for m in facts}
        tasks, active = rows.rdd.getNumPartitions(), set(facts)
        packed = rows.withColumn("part", F.pmod(F.xxhash64("v", "y"), F.lit(parts))).mapInArrow(_pack, "model int, part bigint, x binary, y binary").persist()
        for step in range(spec.steps):
            part = packed.where((F.col("part") == step % parts) & F.col("model").isin(*sorted(active))).select("model", "x", "y")
            sums = _totals(part, _gradients({m: nets[m] for m in active}), tasks)
            for m in sorted(active & set(sums)):
                n, loss, slope = sums[m][0], sums[m][1], sums[m][2:]
                at = nets[m].flat()
                nets[m] = nets[m].moved(adam[m].move(at, slope / n + spec.decay * at))
                losses[m].append(loss / n)
                past = losses[m][-1 - spec.patience * parts:]
                if len(past) > spec.patience * parts and min(past[1:]) > past[0] - spec.tolerance:
                    active.discard(m)
            if not active:
                break
        return nets
    finally:
        rows.unpersist()
        if packed is not None:
            packed.unpersist()


def scorer(net: Net, row_id: str):
    """For mapInArrow over (row id, v): the row id and its prediction."""
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.predict(x), pa.float64())], names=[row_id, "prediction"])
    return run


__all__ = ["Net", "NetSpec", "OUT", "fit_nets", "scorer"]
