"""Each row with the next one in the order of all rows, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import partitions

_LOW = -(1 << 63)


def dealt_by_descending_id(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, bucket and ahead, in partitions sorted by bucket, ahead, descending doc_id (null last) and text.

    A bucket is a range of ids. Its rows with ahead = 1 are copies of those that follow it in the order of all rows:
    of the largest ids of the next bucket below, and for the lowest bucket of the largest of all. So the row after each
    row with ahead = 0 stands in the same bucket. Bounds come from quantiles of the ids: one number for each partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(_LOW)))
    n = partitions(spark)
    bounds = sorted(set(rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"] or []))
    if not bounds:
        bounds = [0]
    powers = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    held = F.lit(bounds)
    # the number of bounds up to the key, bit by bit
    bucket = F.aggregate(powers, F.lit(0), lambda at, p: F.when((at + p <= len(bounds)) & (F.get(held, at + p - 1) <= F.col("key")), at + p).otherwise(at))
    placed = rows.withColumn("bucket", bucket)
    tops = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max("key").alias("top")).collect())
    if not tops:
        tops = [(0, 0)]
    above = {b: tops[(i + 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}
    size = tops[-1][0] + 1
    top, goes = [_LOW] * size, [0] * size
    for b, t in tops:
        top[b], goes[b] = t, above[b]
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"))
    there = F.struct(F.get(F.lit(goes), F.col("bucket")).alias("bucket"), F.lit(1).alias("ahead"))
    to = F.when(F.col("key") == F.get(F.lit(top), F.col("bucket")), F.array(here, there)).otherwise(F.array(here))
    copies = placed.select("doc_id", "text", "key", F.explode(to).alias("to")).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "key", "to.bucket", "to.ahead")
    return copies.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", "ahead", F.col("key").desc(), "text").drop("key")
