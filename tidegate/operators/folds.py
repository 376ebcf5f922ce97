"""Fixed folds, hold-out and grouped splits, all from seeded row order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegate import constants as K
from tidegate.functions.hashing import prefix_digits, ranked_in_class


def fixed_folds(df: DataFrame, y: Column, row_id: str, seed: str = str(K.RANDOM_STATE),
                n_splits: int = K.CV_FOLDS, n_repeats: int = K.CV_REPEATS) -> DataFrame:
    """Add ``fold_0 .. fold_{repeats-1}``: stratified folds, drawn once from the raw rows.

    Class sizes of any two folds differ by at most one row. One shuffle serves all repeats.
    """
    digits = prefix_digits(df.count())
    ranked = ranked_in_class(df, y, row_id, seed, n_repeats, digits)
    return ranked.select(*df.columns, *[
        (F.col(f"rank_{r}") % n_splits).cast("int").alias(f"fold_{r}") for r in range(n_repeats)])


def training_sets(n_splits: int = K.CV_FOLDS, n_repeats: int = K.CV_REPEATS) -> list[Column]:
    """Model conditions, model index = repeat * n_splits + fold."""
    return [F.col(f"fold_{r}") != f for r in range(n_repeats) for f in range(n_splits)]


def holdout_split(df: DataFrame, y: Column, row_id: str, seed: str, test_size: float = K.TEST_SIZE) -> DataFrame:
    """Add ``is_test``: round(test_size * class rows) of every class."""
    digits = prefix_digits(df.count())
    ranked = ranked_in_class(df.withColumn("_y", y), F.col("_y"), row_id, seed, 1, digits)
    quota = class_quota(df.withColumn("_y", y), "_y", test_size)
    return ranked.select(*df.columns, (F.col("rank_0") < quota).alias("is_test"))


def class_quota(df: DataFrame, cls: str, share: float) -> Column:
    """round(share * class size) of the row's class; collects one row per class."""
    quota = F.lit(0)
    for r in df.groupBy(cls).agg(F.count("*").alias("n")).collect():
        quota = F.when(F.col(cls).eqNullSafe(F.lit(r[cls])), round(share * r["n"])).otherwise(quota)
    return quota


def group_key(columns: list[str]) -> Column:
    """md5 over the cells, each with its length before it; NULL has none, so no two rows share a key."""
    cells = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in cells]))


def grouped_split(df: DataFrame, features: list[str], label: str, row_id: str, seed: str,
                  frac: float = K.PILOT_FRAC) -> DataFrame:
    """Add ``is_pilot``. Rows with identical features stay on one side; groups are stratified by the
    label of their first row. The group table is joined back on the group key; a group that holds a
    third of all rows is one row there, and AQE splits its side of the join."""
    keyed = df.withColumn("_g", group_key(features))
    groups = keyed.groupBy("_g").agg(F.min_by(F.col(label).cast("string"), row_id).alias("_cls"))
    digits = prefix_digits(df.count())
    ranked = ranked_in_class(groups, F.col("_cls"), "_g", seed, 1, digits)
    picked = ranked.select("_g", (F.col("rank_0") < class_quota(groups, "_cls", frac)).alias("is_pilot"))
    return keyed.join(picked, "_g").drop("_g")


def partition_fingerprint(df: DataFrame, row_id: str) -> Column:
    """Order-free hash of the row ids of a partition: proves that a split did not move."""
    return F.bit_xor(F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 15), 16, 10).cast("bigint"))
