"""A scorer that SQL can check: the training-fold positive rate of each value of one column.

It stands in for the model when the decision arithmetic (scores, paired gains, bars) is tested
against SQL; real decisions use tidegate.plans.evaluate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegate.operators.metrics import brier, f1


def rate_scores(df: DataFrame, bucket: Column, y: Column, n_splits: int, n_repeats: int,
                rows: Column | None = None) -> DataFrame:
    """(repeat, fold, neg_brier, f1, n_train, n_test) of predicting the bucket's training rate.

    One aggregation to (bucket, y, folds) counts; the fold complement is the total minus the fold. ``rows``: how many
    rows a row of ``df`` stands for, where they have been counted before; this reads ``df`` three times.
    """
    cells = df.groupBy(bucket.alias("b"), y.alias("y"), *[f"fold_{r}" for r in range(n_repeats)]).agg(
        (F.count("*") if rows is None else F.sum(rows)).alias("n"))
    long = cells.select("b", "y", "n", F.posexplode(F.array(*[f"fold_{r}" for r in range(n_repeats)])).alias("repeat", "fold"))
    per = long.groupBy("b", "repeat", "fold").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p"))
    total = long.where("repeat = 0").groupBy("b").agg(F.sum("n").alias("tn"), F.sum(F.col("n") * F.col("y")).alias("tp"))
    every = long.where("repeat = 0").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p")).first()
    prior = F.lit(every["p"] / every["n"])
    seen = F.col("tn") - F.col("n")
    rate = per.join(total, "b").select(
        "repeat", "fold", "n", "p", F.when(seen > 0, (F.col("tp") - F.col("p")) / seen).otherwise(prior).alias("rate"))
    hit = F.col("rate") >= 0.5
    tp, fp, fn = (F.sum(F.when(hit, F.col("p")).otherwise(0)), F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0)),
                  F.sum(F.when(hit, 0).otherwise(F.col("p"))))
    loss = F.col("p") * F.pow(1 - F.col("rate"), 2) + (F.col("n") - F.col("p")) * F.pow("rate", 2)
    return rate.groupBy("repeat", "fold").agg(
        (-F.sum(loss) / F.sum("n")).alias("neg_brier"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        (F.lit(every["n"]) - F.sum("n")).alias("n_train"), F.sum("n").alias("n_test"))
