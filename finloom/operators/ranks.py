"""Places and percentiles of large groups: no task holds a group.

A number's bucket follows from its size alone: 4,096 for each power of two, in order. Buckets of a group are counted, the
counts added up in order, and only rows of one bucket are sorted together. So a group of any size is many tasks', without a
sample and alike in every run; what one task holds of a group is its buckets' counts, some 100,000 at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each power of two, and what keeps a power's number positive.
PER_OCTAVE, SHIFT = 4096, 1100


def bucket(value: Column) -> Column:
    """A whole number that never falls as a number rises; null for null. NaN is above all."""
    v = value.cast("double")
    place = F.floor((F.log2(F.abs(v)) + SHIFT) * PER_OCTAVE).cast("long")
    return F.when(v.isNull(), F.lit(None).cast("long")).when(F.isnan(v), (1 << 40)).when(F.abs(v) == float("inf"), F.when(v > 0, 1 << 39).otherwise(-(1 << 39))).when(v == 0, 0).when(v > 0, place).otherwise(-place)


def numbered(df: DataFrame, group: str, value: str, tie: str, name: str, descending: bool = True) -> DataFrame:
    """df with name: each row's place in its group, from 1, by value (nulls last), then by tie.

    Where values are null or 0, of which there may be very many, rows are parted by the size of a numeric tie too.
    """
    v, numeric = F.col(value), dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    up = bucket(v)
    held = df.withColumn("_b", F.coalesce(-up if descending else up, F.lit(1 << 41)))
    second = F.when(v.isNull() | (v.cast("double") == 0), bucket(F.col(tie)) if numeric else F.lit(None).cast("long"))
    held = held.withColumn("_t", F.coalesce(second, F.lit(-(1 << 41))))
    counts = held.groupBy(group, "_b", "_t").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_b", "_t")) - F.col("_n")
    starts = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.col("_t").alias("_u"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_b", "_t").orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last(), tie))
    met = held.withColumn("_own", own).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")) & (F.col("_t") == F.col("_u")))
    return met.select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def percentiles(values: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """keys, n and profile: the values at the shares `at` of each key's values, between two by their distance. Null values
    don't count. Equal values are counted together first, so they are one row however often they stand."""
    once = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", bucket(F.col("_v")))
    counts = once.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*keys)
    starts = counts.select(*keys, "_b", (F.sum("_m").over(whole.orderBy("_b")) - F.col("_m")).alias("_before"), F.sum("_m").over(whole).alias("n"), F.col("_m").alias("_size"))
    # only buckets in which a value stands that is asked for go on
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    asked = [f(place(q)) for q in at for f in (F.floor, F.ceil)]
    hit = F.exists(F.array(*asked), lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_size")))
    rows = once.join(starts.where(hit), [*keys, "_b"])
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    found = rows.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))
    of = lambda p: F.max(F.when((p >= F.col("_start")) & (p < F.col("_end")), F.col("_v")))
    ends = found.groupBy(*keys, "n").agg(*(of(f(place(q))).alias(f"_{side}{i}") for i, q in enumerate(at) for side, f in (("low", F.floor), ("high", F.ceil))))

    def between(i: int, q: float) -> Column:
        p, low, high = place(q), F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return ends.select(*keys, "n", F.array(*(between(i, q) for i, q in enumerate(at))).alias("profile"))
