"""Events against price series: returns, the days after an event, labels and their purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import return_label


def daily_returns(prices: DataFrame, key: str, day: str, close: str) -> DataFrame:
    """prices with a close, and change: percent against the key's row before; null for the first."""
    before = F.lag(close).over(Window.partitionBy(key).orderBy(day))
    return prices.where(F.col(close).isNotNull()).withColumn("change", F.try_divide(F.col(close), before) * 100 - 100)


def event_study(events: DataFrame, prices: DataFrame, key: str, event: str, event_day: str, day: str, close: str, days: int = 5, within: int = 7) -> DataFrame:
    """key, event, base_day, base_close, end_day, end_close, change (percent) and label of each event that has them.

    The base is the key's first priced day after the event, at most within days later; the end is the days-th priced
    day after the base. prices: one row for each key and day; null closes are no days. The two tables meet by key and
    week, an event in the weeks its days fall in, so no key's events meet all its prices.
    """
    w = Window.partitionBy(key).orderBy(day)
    priced = prices.where(F.col(close).isNotNull()).select(key, F.col(day).alias("_day"), F.col(close).alias("_close"), F.lead(day, days).over(w).alias("_end_day"), F.lead(close, days).over(w).alias("_end_close"))
    week = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date")).cast("long") / within
    span = F.sequence(F.floor(week(F.col(event_day))), F.floor(week(F.date_add(event_day, within))))
    asked = events.select(key, event, F.col(event_day).alias("_event_day"), F.explode(span).alias("_week"))
    met = asked.join(priced.withColumn("_week", F.floor(week(F.col("_day")))), [key, "_week"]).where((F.col("_day") > F.col("_event_day")) & (F.col("_day") <= F.date_add("_event_day", within)))
    base = met.groupBy(key, event).agg(F.min_by(F.struct("_day", "_close", "_end_day", "_end_close"), "_day").alias("b"))
    out = base.select(key, event, F.col("b._day").alias("base_day"), F.col("b._close").alias("base_close"), F.col("b._end_day").alias("end_day"), F.col("b._end_close").alias("end_close"))
    change = F.try_divide(F.col("end_close"), F.col("base_close")) * 100 - 100
    return out.where("end_day IS NOT NULL").withColumn("change", change).withColumn("label", return_label("change"))


def label_counts(labels: DataFrame, label: str, missing: str = "unlabelled") -> DataFrame:
    """label and n, with a row for those without and one, total, for all."""
    named = labels.select(F.coalesce(label, F.lit(missing)).alias("label"))
    return named.rollup("label").agg(F.count("*").alias("n")).select(F.coalesce("label", F.lit("total")).alias("label"), "n")


def purity(labels: DataFrame, label: str, quiet: Column) -> DataFrame:
    """population (all, quiet), n, decided (neither neutral nor null) and share of decided, 4 places; 0 for none."""
    sides = labels.select(F.explode(F.array_compact(F.array(F.lit("all"), F.when(quiet, "quiet")))).alias("population"), F.coalesce(F.col(label) != "neutral", F.lit(False)).alias("_d"))
    found = sides.groupBy("population").agg(F.count("*").alias("n"), F.count_if("_d").alias("decided"))
    return found.withColumn("share", F.round(F.coalesce(F.try_divide("decided", "n"), F.lit(0.0)), 4))


def without_bursts(df: DataFrame, keys: list[str], burst: Column, most: int = 5) -> DataFrame:
    """df without the rows that burst marks where a key has more than most of them."""
    n = df.where(burst).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.lit(True).alias("_busy"))
    return df.join(n, keys, "left").where(~(burst & F.coalesce("_busy", F.lit(False)))).drop("_busy")
