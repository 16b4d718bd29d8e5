"""Two runs of scores beside each other: what came, what went, and how far the others moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import top_per_key
from .ranks import percentiles


def compared_scores(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """key, old_score, new_score, delta (where both have one) and state: common, new, gone, scored (had none), lost (has none
    now) or unscored. One row for each key and table."""
    both = old.select(key, F.col(score).cast("double").alias("old_score"), F.lit(True).alias("_o")).join(new.select(key, F.col(score).cast("double").alias("new_score"), F.lit(True).alias("_n")), key, "full_outer")
    had, has = F.col("old_score").isNotNull(), F.col("new_score").isNotNull()
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(had & has, "common").when(has, "scored").when(had, "lost").otherwise("unscored")
    return both.select(key, "old_score", "new_score", (F.col("new_score") - F.col("old_score")).alias("delta"), state.alias("state"))


def delta_summary(rows: DataFrame) -> DataFrame:
    """One row of compared_scores: how many of each state, and the mean, median and largest move of the common ones."""
    counts = rows.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("common", "new", "gone", "scored", "lost", "unscored")), F.avg("delta").alias("mean_delta"), F.max(F.abs("delta")).alias("largest"))
    median = percentiles(rows.select(F.lit(1).alias("_k"), "delta"), ["_k"], "delta", [0.5]).select(F.get("profile", F.lit(0)).alias("median_delta"))
    return counts.join(median, F.lit(True), "left")  # one row by one or none


def largest_moves(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n common rows that moved farthest, with place; ties by key."""
    order: list[Column] = [F.abs("delta").desc(), F.col(key)]
    return top_per_key(rows.where("delta IS NOT NULL").withColumn("_all", F.lit(1)), ["_all"], order, n, "place").drop("_all")
