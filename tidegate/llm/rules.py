"""Quality rules: text statistics and a decision list learned by sequential covering.

Rules are grown on two thirds of a labelled sample and pruned on the rest: a rule is a conjunction of
thresholds that covers rejected documents; it is added while it is precise enough on the pruning
rows, and what it covers is set aside. The list is an ordered chain of Spark conditions.

Defined cases: a null or empty text has no words and every count 0; labels that are null, or rows
without a label, are not learned from; without labels of both classes the list is empty and keeps
all; repeated rows count as often as they appear; other columns of the input are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.text import SPACE, as_bytes

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
UPPER, MARKS, DIGITS = bytes(range(65, 91)), b"!?;:()[]{}=+/\\_~^@", b"0123456789"


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside ``width``-word windows found twice or more, first ones included. Windows are
    ranked pair by pair, so memory stays a few integers a word for a text of any length."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    rank = one[:n]
    for k in range(1, width):
        values, rank = np.unique(rank * len(ids) + one[k:k + n], return_inverse=True)
        if len(values) == n:
            return 0
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one whole text."""
    raw = as_bytes(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (len(words), len(raw.translate(None, SPACE + CONTINUATION)), without(SYMBOLS), len(lines) - len(set(lines)),
            repeat_words(words), len(lines), without(UPPER), without(MARKS), without(DIGITS))


def text_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and COUNTS of every document; ``carry`` adds columns of the input, renamed k_<name>."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        for b in batches:
            rows = [text_counts(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.asarray(v, np.int64)) for v in cols], *b.columns[2:]],
                                             names=["doc_id", *COUNTS, *[f"c{i}" for i in range(len(carry))]])
    schema = ", ".join(["doc_id bigint", *[f"{c} bigint" for c in COUNTS], *[f"c{i} {kinds[c]}" for i, c in enumerate(carry)]])
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"c{i}": f"k_{c}" for i, c in enumerate(carry)})


def features() -> dict[str, Column]:
    """What rules may test: shares of the counts, from the columns of ``text_statistics``."""
    c = {k: F.col(k).cast("double") for k in COUNTS}
    return {"symbols_per_word": c["n_symbols"] / F.greatest(c["n_words"], F.lit(1.0)),
            "marks_per_word": c["n_marks"] / F.greatest(c["n_words"], F.lit(1.0)),
            "upper_share": c["n_upper"] / F.greatest(c["word_chars"], F.lit(1.0)),
            "digit_share": c["n_digits"] / F.greatest(c["word_chars"], F.lit(1.0)),
            "chars_per_word": c["word_chars"] / F.greatest(c["n_words"], F.lit(1.0)),
            "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
            "repeat_share": c["n_repeat_words"] / F.greatest(c["n_words"], F.lit(1.0)),
            "words_per_line": c["n_words"] / F.greatest(c["n_lines"], F.lit(1.0)),
            "n_words": c["n_words"]}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``feature`` >= value (above) or < value."""
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] < self.value

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] >= F.lit(self.value) if self.above else f[self.feature] < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:.6g}"


@dataclass(frozen=True)
class RuleSpec:
    sample_rows: int = 20_000       # labelled documents learned from, the first by hash of doc_id
    thresholds: int = 64            # candidate cuts per feature and rule
    max_tests: int = 4
    max_rules: int = 24
    precision: float = 0.9          # of a rule, on the pruning rows
    least: int = 3                  # rejected documents a rule covers on the growing rows
    seed: str = "rules"


def covers(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for t in rule:
        hit &= t.holds(x)
    return hit


def _cuts(v: np.ndarray, most: int) -> np.ndarray:
    u = np.unique(v)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(mid[np.linspace(0, len(mid) - 1, most).astype(int)])


def grow(x: dict[str, np.ndarray], bad: np.ndarray, spec: RuleSpec) -> list[Test]:
    """Add the test of largest information gain until only rejected documents are covered."""
    rule, hit = [], np.ones(len(bad), bool)
    while len(rule) < spec.max_tests and (~bad[hit]).any():
        p0, n0 = int(bad[hit].sum()), int(hit.sum())
        best = (1e-9, None)
        for name in x:
            v, y = x[name][hit], bad[hit]
            order = np.argsort(v, kind="stable")
            run = np.concatenate([[0], np.cumsum(y[order])])
            cuts = _cuts(v[y], spec.thresholds) if y.any() else np.empty(0)
            cuts = np.unique(np.concatenate([cuts, _cuts(v, spec.thresholds)]))
            below = np.searchsorted(v[order], cuts, "left")
            for above in (True, False):
                n = n0 - below if above else below
                p = p0 - run[below] if above else run[below]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= spec.least, p * (np.log2(p / n) - np.log2(p0 / n0)), -1)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), Test(name, above, float(cuts[int(gain.argmax())])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].holds(x)
    return rule


def prune(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """Drop final tests while that does not lower (p - n) / (p + n) on the pruning rows."""
    def worth(r):
        hit = covers(r, x, len(bad))
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, spec: RuleSpec = RuleSpec()) -> list[list[Test]]:
    """The ordered list of rules that reject."""
    rules: list[list[Test]] = []
    rng = np.random.default_rng(7)
    open_ = np.ones(len(bad), bool)
    while len(rules) < spec.max_rules and bad[open_].sum() >= spec.least:
        fold = rng.random(len(bad)) < 2 / 3
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = grow(*part(open_ & fold), spec)
        if not rule:
            break
        rule = prune(rule, *part(open_ & ~fold))
        hit = covers(rule, x, len(bad))
        held, fresh = hit & open_ & ~fold, hit & open_
        if not fresh.any() or bad[fresh].mean() < spec.precision or (held.any() and bad[held].mean() < spec.precision):
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, spec: RuleSpec = RuleSpec()) -> list[list[Test]]:
    """Rules from a bounded sample of the labelled documents; only its numbers reach the driver."""
    first = F.md5(F.concat(F.lit(spec.seed), F.col("doc_id").cast("string")))
    marked = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
              .orderBy(first, "quality").limit(spec.sample_rows))                     # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    got = (text_statistics(texts).join(F.broadcast(marked), "doc_id").select("doc_id", F.col("quality").alias("q"), *[v.alias(f"f_{k}") for k, v in features().items()])
           .orderBy(first, "q").limit(spec.sample_rows).toPandas())
    got = got.sort_values(list(got.columns), kind="stable")
    return learn({k: got[f"f_{k}"].to_numpy(float) for k in features()}, got["q"].to_numpy() == 0, spec)


def verdict(rules: list[list[Test]]) -> Column:
    """False where the first rule that holds rejects, else True."""
    f = features()
    out = None
    for rule in rules:
        cond = F.lit(True)
        for t in rule:
            cond = cond & t.column(f)
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))
