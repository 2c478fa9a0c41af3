"""Outcome classes, confusion and retrieval metrics (M1-M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(annotations: DataFrame, bound: DataFrame) -> DataFrame:
    """M1: annotations (file, line, callee, expected) against bound calls (file, line, callee, target):
    tp, fp (a wrong or unwanted target), fn, tn."""
    first = bound.groupBy("file", "line", "callee").agg(F.min("target").alias("target"))
    rows = annotations.join(first, ["file", "line", "callee"], "left")
    wanted, got = F.col("expected").isNotNull(), F.col("target").isNotNull()
    outcome = F.when(wanted & got & (F.col("expected") == F.col("target")), "tp").when(got, "fp").when(wanted, "fn").otherwise("tn")
    return rows.withColumn("outcome", outcome)


def confusion(rows: DataFrame, group: str) -> DataFrame:
    """M2: counts and ratios of ``outcome`` by group, and in total (group null)."""
    counts = rows.rollup(group).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn", "tn")])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0))
    accuracy = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn")), F.lit(1.0))
    return counts.withColumns({"precision": p, "recall": r, "accuracy": accuracy}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def retrieval(ranks: DataFrame) -> DataFrame:
    """M3: mean reciprocal rank, recall at 1 and 5, from (query, rank); a miss has a null rank."""
    best = ranks.groupBy("query").agg(F.min("rank").alias("rank"))
    return best.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("rank") <= 1).cast("double"), F.lit(0.0))).alias("r1"), F.avg(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))).alias("r5"))
