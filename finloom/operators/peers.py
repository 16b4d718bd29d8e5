"""Peers: percentile profiles of hierarchical groups, and ranks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import PEER_PERCENTILES
from .ranks import numbered, percentiles


def profiles(values: DataFrame, groups: Column, metric: str, value: str, fewest: int | Column = 20) -> DataFrame:
    """group, metric, n and profile (the values at PEER_PERCENTILES, interpolated) of groups with fewest values.

    groups: an array of the groups that a row belongs to. Null values and groups don't count.
    """
    each = values.where(F.col(value).isNotNull()).select(F.explode(groups).alias("group"), F.col(metric).alias("metric"), F.col(value).alias("value"))
    found = percentiles(each.where(F.col("group").isNotNull()), ["group", "metric"], "value", PEER_PERCENTILES)
    return found.where(F.col("n") >= fewest)


def with_profile(rows: DataFrame, groups: Column, metric: str, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the profile (and its group) of the first of their groups that has one for their metric.

    keys: what a row is known by, with metric. Profiles are few (groups by metrics), yet how many isn't known here:
    Spark picks the join.
    """
    places = rows.select(*keys, metric, F.posexplode(groups).alias("_place", "group"))
    met = places.join(found.select("group", F.col("metric").alias(metric), "profile"), ["group", metric])
    best = met.groupBy(*keys, metric).agg(F.min_by(F.struct("group", "profile"), "_place").alias("_best"))
    return rows.join(best, [*keys, metric], "left").withColumn("peer_group", F.col("_best.group")).withColumn("profile", F.col("_best.profile")).drop("_best")


def rank_percentile(df: DataFrame, group: str, value: str, tie: str, high_is_better: bool = True, fewest: int = 3) -> DataFrame:
    """df with percentile: 100 for the best of the group's values, 0 for the worst, a whole number; null for null values
    and groups of fewer. Ties go by the column tie."""
    n = df.groupBy(F.col(group).alias("_g")).agg(F.count(value).alias("_n"))
    ranked = numbered(df, group, value, tie, "_place", high_is_better).join(n, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("_place", F.col("_place") - 1)
    share = F.bround((F.col("_n") - 1 - F.col("_place")) / (F.col("_n") - 1) * 100, 0).cast("int")
    return ranked.withColumn("percentile", F.when(F.col(value).isNotNull() & (F.col("_n") >= fewest), share)).drop("_place", "_n")


def market_tiers(df: DataFrame, market: str, cap: str, tie: str, named: int = 200) -> DataFrame:
    """df with market_rank (by cap, nulls last) and tier: named for the first of each market that have a cap, else dot."""
    ranked = numbered(df, market, cap, tie, "market_rank")
    return ranked.withColumn("tier", F.when((F.col("market_rank") <= named) & F.col(cap).isNotNull(), "named").otherwise("dot"))


#: Fixed value: the angle between neighbours of a sunflower's head, in radians.
GOLDEN_ANGLE = 2.399963229728653


def spiral(df: DataFrame, group: str, value: str, tie: str, step: float = 1.0) -> DataFrame:
    """df with x and y: the rows of each group on a spiral, the one of the highest value in the middle; ties go by tie."""
    place = numbered(df, group, value, tie, "_i").withColumn("_i", F.col("_i") - 1)
    return place.withColumn("x", F.sqrt("_i") * step * F.cos(F.col("_i") * GOLDEN_ANGLE)).withColumn("y", F.sqrt("_i") * step * F.sin(F.col("_i") * GOLDEN_ANGLE)).drop("_i")
