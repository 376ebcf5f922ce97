"""Saved recipes on streams: the stateless steps of a recipe clean rows as they arrive."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators.repair import RepairError, replay_recipe

STATELESS = ("fill_mean", "fill_median", "fill_mode", "fill_unknown", "clip_outliers", "sentinel_to_median",
             "rescale_units", "normalize_categories", "drop_rows")


def replay_stream(stream: DataFrame, recipe: list[dict]) -> DataFrame:
    """The recipe as a streaming transformation. Removing copies needs all earlier rows, so a
    recipe with dedupe_rows is refused rather than run with partial memory."""
    stateful = [r["op"] for r in recipe if r["op"] not in STATELESS]
    if stateful:
        raise RepairError(f"not stateless: {stateful}")
    return replay_recipe(stream, recipe)


def clean_to_parquet(stream: DataFrame, recipe: list[dict], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append cleaned rows to Parquet, exactly once per input row across restarts of the checkpoint."""
    writer = replay_stream(stream, recipe).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()
