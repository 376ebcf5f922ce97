"""Small helpers the operators share: words, lower-casing and Arrow output."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.session import written

SPACE = b" \t\n\x0b\x0c\r"             # what separates words; bytes.split() uses the same six
WORD = r"[^\x20\x09-\x0D]+"


def as_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty. A lone surrogate cannot be encoded and becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of every word of ``raw``."""
    b = np.frombuffer(raw, np.uint8)
    solid = np.empty(len(b) + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts go to Python tasks in batches of at most ``rows``, where the session leaves the
    batch size at Spark's default: with long texts 10,000 rows are too many for a small executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def small_enough(ids: DataFrame, most: int) -> DataFrame:
    """``ids``, marked for broadcast if it has at most ``most`` rows; a join shuffles it otherwise."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def told_apart(docs: DataFrame, name: str = "twin", small: int = 500_000) -> DataFrame:
    """``docs`` and a column ``name`` that tells rows of one doc_id with different texts apart: a hash of
    the text where the doc_id has several texts, else 0. Rows that repeat doc_id and text stay one document."""
    mark = F.xxhash64("text")
    several = (docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("_several"))
               .agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("_several"))
    held = small_enough(written(several, "several-texts"), small)
    return (docs.join(held, docs["doc_id"].cast("bigint") == held["_several"], "left")
            .withColumn(name, F.when(F.col("_several").isNotNull(), mark).otherwise(F.lit(0).cast("bigint"))).drop("_several"))
