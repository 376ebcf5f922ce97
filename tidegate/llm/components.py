"""Connected components of a link table by alternating large-star and small-star rounds.

A round moves every link towards the smallest node around it; the number of rounds is logarithmic
even for long chains. Neighbourhoods are only ever reduced to their minimum (combined before the
shuffle) and joined back: by a broadcast where links are few, else a star with a third of all links is split by
adaptive skew joins.
Every round is a table in the shared folder; only its link count and checksum reach the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegate.session import FEW_ROWS, few_files, written


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _held(low: DataFrame, links: int) -> DataFrame:
    """The minima, sent to every task where so few links cannot have many: then the links are not shuffled to meet them."""
    return F.broadcast(low) if links <= FEW_ROWS else low


def components(links: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """node, root: every node of a link, with the smallest node it reaches. ``most``: rows of ``links`` at most, if known."""
    edges = written(few_files(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), most), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _held(_mins(both).select("u", F.least("u", "m").alias("m")), mark[0])
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(few_files(large, mark[0]), "large-star")               # one row a link; rows that repeat go with the small star
        low = _held(_mins(large), mark[0])
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(few_files(small, 2 * mark[0]), "small-star")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(       # stars: no root is a leaf
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a link table."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]
