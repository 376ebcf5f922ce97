"""Language of web pages by fusing four pieces of evidence in log space.

1. Text: a naive Bayes likelihood over hashed byte trigrams, counted per language over all labelled
   documents (a table of languages x ``slots``, whatever the corpus holds).
2. Declared markup language: how often pages whose text says l declare m, smoothed.
3. Address suffix (two-letter top-level domains; all others together): likewise.
4. Host: the share of each language among the host's other pages by text, smoothed towards its
   domain, that towards its top-level domain and that towards all pages.

Tables 2 to 4 are grouped aggregations over all pages; host, domain and top-level counts are joined
back on their keys and a page's own vote is taken out again. Long texts do not drown the other
evidence: the text's log likelihood is scaled to at most ``most_trigrams`` trigrams.

Defined cases: a null html has no text and declares nothing, a null url has the empty host; a page
without any evidence gets the prior; ties go to the language that sorts first; repeated rows are
separate pages; an empty table gives no rows; without labelled documents no language is known and
``lang`` is null; other columns are ignored.
"""
from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegate.llm.text import as_bytes
from tidegate.session import written


@dataclass(frozen=True)
class LangSpec:
    slots: int = 1 << 14
    alpha: float = 0.05             # added to every trigram count, per slot
    most_trigrams: int = 60
    evidence: float = 2.0           # pseudo-pages of the declared and suffix tables
    host: float = 8.0               # pseudo-pages of each level of the host prior
    most_languages: int = 256       # labels beyond the commonest ones are not modelled


OPENER = re.compile(rb"<(?:(script|style)\b|(!--))?", re.I)
CLOSER = {b"script": re.compile(rb"</script\s*>", re.I), b"style": re.compile(rb"</style\s*>", re.I), b"!--": re.compile(rb"-->"), b"": re.compile(rb">")}
DECLARED = r"(?i)<html[^<>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})"        # stops at the next tag, so it stays linear on unclosed ones


def visible(raw: bytes) -> bytes:
    """``raw`` with one space for every tag, comment, script and style. A script, style or comment that
    never closes is a plain tag, a tag that never closes is text. One pass: a closer that is missing
    from some place on is missing from every later place, so it is searched for in vain only once."""
    parts, at, missing = [], 0, set()
    here = raw.find(b"<")
    while here >= 0 and b"" not in missing:
        found = OPENER.match(raw, here)
        stop = -1
        for kind in dict.fromkeys(((found[1] or found[2] or b"").lower(), b"")):
            close = None if kind in missing else CLOSER[kind].search(raw, found.end() if kind else here + 1)
            if close:
                stop = close.end()
                break
            missing.add(kind)
        if stop >= 0:
            parts.append(raw[at:here])
            at = stop
        here = raw.find(b"<", max(stop, here + 1))
    return b" ".join([*parts, raw[at:]])


def page_text(html: str | None) -> bytes:
    """The text outside of tags, scripts, styles and comments; entities are resolved."""
    return as_bytes(entities.unescape(visible(as_bytes(html)).decode("utf-8", "replace")))


def trigram_slots(raw: bytes, slots: int) -> np.ndarray:
    """Hash slot of every byte trigram; digits and runs of white space count as one space."""
    b = np.frombuffer(b" " + b" ".join(raw.lower().translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    t = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (t >> np.uint32(16)).astype(np.int64) % slots


_FOLD = bytes(32 if chr(i) in "0123456789.,;:!?()[]{}|#*$%&<>\"'/\\-_=+" else i for i in range(256))


def trigram_counts(docs: DataFrame, spec: LangSpec) -> DataFrame:
    """lang, slot, n over all texts; every task sends at most one count per language and slot."""
    schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = total.setdefault(lang, np.zeros(spec.slots, np.int64))
                own += np.bincount(trigram_slots(as_bytes(text.as_py()), spec.slots), minlength=spec.slots)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=schema)
    return docs.select("lang", "text").mapInArrow(run, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass
class TextModel:
    langs: list[str]
    logs: np.ndarray                # (languages, slots)
    spec: LangSpec


def train_text(docs: DataFrame, spec: LangSpec = LangSpec()) -> TextModel:
    """The driver gets languages x slots counts at most."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    top = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(spec.most_languages).collect()
    langs = sorted(r["lang"] for r in top)
    counts = np.full((len(langs), spec.slots), spec.alpha)
    got = trigram_counts(known.where(F.col("lang").isin(langs)), spec).toPandas() if langs else None
    if got is not None and len(got):
        np.add.at(counts, (np.searchsorted(langs, got["lang"].to_numpy(str)), got["slot"].to_numpy()), got["n"].to_numpy())
    return TextModel(langs, np.log(counts / counts.sum(axis=1, keepdims=True)), spec)


def text_evidence(pages: DataFrame, m: TextModel) -> DataFrame:
    """page_id, url, declared, text_log (one log likelihood per language, the largest 0), text_best."""
    def run(batches):
        for b in batches:
            logs, best = [], []
            for html in b.column("html"):
                at = trigram_slots(page_text(html.as_py()), m.spec.slots)
                v = m.logs[:, at].sum(axis=1) * min(1.0, m.spec.most_trigrams / len(at)) if len(at) else np.zeros(len(m.langs))
                logs.append(v - v.max(initial=-np.inf) if len(v) else v)
                best.append(int(v.argmax()) if len(at) and len(v) else None)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("declared"), pa.array(logs, pa.list_(pa.float64())), pa.array(best, pa.int32())],
                                             names=["page_id", "url", "declared", "text_log", "text_best"])
    said = F.lower(F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1), F.lit("")))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", said.alias("declared")).mapInArrow(
        run, "page_id bigint, url string, declared string, text_log array<double>, text_best int")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _votes(n: int) -> list[Column]:
    return [F.count_if(F.col("text_best") == i).cast("double").alias(f"v{i}") for i in range(n)]


def _vector(prefix: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) for i in range(n)]) if n else F.array().cast("array<double>")


def _smoothed(votes: Column, prior: Column, weight: float) -> Column:
    size = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(votes, prior, lambda v, p: (v + weight * p) / (size + weight))


def fuse(pages: DataFrame, m: TextModel) -> DataFrame:
    """page_id, host, declared, text_lang, lang, probability."""
    spark, n, spec = pages.sparkSession, len(m.langs), m.spec
    suffix = F.regexp_extract("host", r"\.([a-z]{2})$", 1)
    seen = written(text_evidence(pages, m).withColumn("host", host_of(F.col("url"))).withColumns({
        "domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "top": F.regexp_extract("host", r"([^.]*)$", 1), "suffix": suffix,
        "said": F.when(F.col("declared").isin(m.langs), F.col("declared")).when(F.col("declared").isNull(), "none").otherwise("other")}).drop("url"), "page-text")
    if not n:
        return seen.select("page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    alls = seen.agg(*_votes(n)).first()
    total = np.array([alls[f"v{i}"] or 0 for i in range(n)], float)
    prior = (total + 1) / (total.sum() + n)

    def table_of(key: str, values: list[str]) -> Column:
        """Map value -> log P(value | language) per language, from counts over all pages; at most
        languages + 2, or 26 * 26 + 1, rows reach the driver."""
        got = {r[key]: np.array([r[f"v{i}"] for i in range(n)]) for r in seen.groupBy(key).agg(*_votes(n)).collect()}
        names = sorted(set(got) | set(values))
        p = np.array([got.get(v, np.zeros(n)) for v in names])
        share = (p.sum(axis=1) + 1) / (p.sum() + len(names))
        logs = np.log((p + spec.evidence * share[:, None]) / (p.sum(axis=0) + spec.evidence))
        return spark.createDataFrame([(v, x.tolist()) for v, x in zip(names, logs)], f"{key} string, {key}_log array<double>")

    out = seen.join(F.broadcast(table_of("said", [*m.langs, "none", "other"])), "said").join(F.broadcast(table_of("suffix", [""])), "suffix")     # bounded as said
    for level in ("top", "domain", "host"):
        votes = seen.groupBy(level).agg(*_votes(n)).select(F.col(level), _vector("v", n).alias(f"{level}_votes"))
        out = out.join(votes, level)
    own = F.array(*[F.when(F.col("text_best") == i, 1.0).otherwise(0.0) for i in range(n)])
    smooth = F.array(*[F.lit(float(x)) for x in prior])
    for level in ("top", "domain", "host"):
        rest = F.zip_with(f"{level}_votes", own, lambda a, b: a - b)
        out = out.withColumn(f"{level}_prior", _smoothed(rest, smooth, spec.host))
        smooth = F.col(f"{level}_prior")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("text_log"), F.col("said_log")), add(F.col("suffix_log"), F.transform("host_prior", lambda p: F.log(p))))
    names = F.array(*[F.lit(x) for x in m.langs])
    done = out.withColumn("logs", logs).withColumn("best", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return done.select("page_id", "host", "declared", F.get(names, F.col("text_best")).alias("text_lang"),
                       F.element_at(names, F.array_position("logs", F.col("best")).cast("int")).alias("lang"), (1 / mass).alias("probability"))
