"""Evaluation: precision and recall of sets, agreement, samples by hash, and bootstrap intervals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def micro_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 (4 places; 0 where undefined) over the rows of two tables of like columns."""
    keys = truth.columns
    both = truth.distinct().withColumn("_t", F.lit(1)).join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "full_outer")
    n = both.agg(F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumn("_p", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("_r", over(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.select("tp", "fp", "fn", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"), F.round(over(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), 4).alias("f1"))


def confusion(truth: DataFrame, found: DataFrame, keys: list[str], label: str) -> DataFrame:
    """expected, given and n of the rows that both tables have under keys."""
    pairs = truth.select(*keys, F.col(label).alias("expected")).join(found.select(*keys, F.col(label).alias("given")), keys)
    return pairs.groupBy("expected", "given").agg(F.count("*").alias("n"))


def hash_order(seed: str, key: str) -> Column:
    """A number between 0 and 2^32 from md5 of seed and key: an order that doesn't depend on the rows' places."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def stratified(df: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """A share of each stratum's rows (rounded down, one at least), the first by hash order."""
    n = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    placed = numbered(df.withColumn("_h", hash_order(seed, key)), stratum, "_h", key, "_i", False).join(n, F.col(stratum).eqNullSafe(F.col("_s")))
    return placed.where(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).select(*df.columns)


def direction_confusion(truth: DataFrame, found: DataFrame, keys: list[str], labels: list[str], most: int = 10) -> DataFrame:
    """expected, given and n: of found rows that aren't true, how often truth has other labels under the same keys; the
    most frequent, ties by name. Rows count once; labels are written with / between. A row with a null is never true.
    Both tables are grouped together once, and each side of the join picks its rows of that."""
    columns = [*keys, *labels]
    rows = truth.select(*columns, F.lit(1).alias("_in")).unionByName(found.select(*columns, F.lit(2).alias("_in")))
    once = rows.groupBy(*columns).agg(F.bit_or("_in").alias("_in"))  # 1: true, 2: found, 3: both
    unknown = reduce(or_, (F.col(c).isNull() for c in columns))
    text = lambda df, name: df.select(*keys, F.concat_ws("/", *labels).alias(name))
    met = text(once.where((F.col("_in") == 2) | ((F.col("_in") == 3) & unknown)), "given").join(text(once.where("_in <> 2"), "expected"), keys)
    return met.groupBy("expected", "given").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "given").limit(most)


def bootstrap_f1(truth: DataFrame, found: DataFrame, chunk: str, rounds: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """f1, low and high: micro F1 of two tables of like columns, and its interval over rounds of Poisson resampling of
    chunks: each counts in each round as often as a hash of seed, round and chunk tells (0 to 6). Chunks meet rounds in
    their own task; sums of chunks and rounds are shuffled."""
    keys = truth.columns
    both = truth.distinct().withColumn("_t", F.lit(1)).join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "full_outer")
    per = both.groupBy(chunk).agg(F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_b").cast("string"), F.col(chunk).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # The Poisson(1) distribution's sums
    times = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).when(u < 0.99940582, 5).otherwise(6)
    each = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("_b")).withColumn("_k", F.when(F.col("_b") == 0, 1).otherwise(times))
    sums = each.groupBy("_b").agg(*(F.sum(F.col(c) * F.col("_k")).alias(c) for c in ("tp", "fp", "fn")))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    one = sums.agg(F.max(F.when(F.col("_b") == 0, f1)).alias("f1"), F.sort_array(F.collect_list(F.when(F.col("_b") > 0, f1))).alias("_l"))
    return one.select("f1", F.get("_l", F.lit(int(alpha / 2 * rounds))).alias("low"), F.get("_l", F.lit(min(rounds - 1, int((1 - alpha / 2) * rounds)))).alias("high"))
