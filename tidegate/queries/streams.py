"""Recipe replay on a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.operators.repair import fit_recipe
from tidegate.queries.registry import query
from tidegate.session import scratch_path
from tidegate.sources.tables import table
from tidegate.streaming.replay import clean_to_parquet


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
  SELECT event_id, event_type, round(greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), value)), 6) AS value FROM events, q""")
def recipe_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the batch table, then clean the same files as they arrive on a stream."""
    events = table(spark, sf, "events")
    _, recipe = fit_recipe(events, {"value": "clip_outliers", "event_type": "normalize_categories"})
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = scratch_path(spark, "stream-out")
    clean_to_parquet(stream, recipe, out, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type", F.round("value", 6).alias("value"))
