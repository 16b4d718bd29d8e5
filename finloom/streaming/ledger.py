"""Tables kept by micro-batches that may be run again, and ledgers of attempts from which work is resumed.

Each batch writes parts of its own (day and batch, or batch alone) and replaces them if it is run again, so nothing is
counted twice after a failure. What is there already is read from the batch's own days alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder at path, in whatever store that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _replace(rows: DataFrame, path: str, parts: Sequence[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def append_batch(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], day: str) -> None:
    """Adds those rows of a micro-batch whose (keys, day) the table at path lacks, one for each: for foreachBatch.

    The table has a part for each day and batch; only those of the batch's days, written by other batches, are read, and
    their keys alone. A batch that is run again, in part or whole, replaces its parts. Of several rows of one key the least
    is taken. day: a date column. batch_id tells batches of one query and checkpoint apart: a table belongs to one.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in (*keys, day)]
    once = batch.groupBy(*keys, day).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, day, *(F.col("_r")[c].alias(c) for c in rest)) if rest else batch.distinct()
    days = [r[0] for r in batch.select(day).distinct().collect()]  # a batch's days are few
    if days and is_there(spark, path):
        schema = StructType([*(f for f in batch.schema if f.name != day), batch.schema[day]]).add("batch", "long")
        old = spark.read.schema(schema).parquet(path).where(F.col(day).isin(days) & (F.col("batch") != batch_id)).select(*keys, day)
        once = once.join(old, [*keys, day], "left_anti")
    if days:
        _replace(once.withColumn("batch", F.lit(batch_id).cast("long")), path, [day, "batch"])


def keep(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], day: str, every: str | None = None):
    """Starts a query that keeps the table at path by append_batch: each `every`, or all there is now and then ends."""
    writer = stream.writeStream.foreachBatch(lambda df, n: append_batch(df, n, path, keys, day)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


ATTEMPTS = "code string, ok boolean, note string, batch long"


def record_attempts(results: DataFrame, batch_id: int, path: str) -> None:
    """Writes results (code, ok, note) as the attempts of one batch, in place of any that it has written before."""
    _replace(results.select(F.col("code").cast("string"), "ok", "note").withColumn("batch", F.lit(batch_id).cast("long")), path, ["batch"])


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """All attempts (code, ok, note, batch) of a ledger; none if there is no ledger yet."""
    return spark.read.schema(ATTEMPTS).parquet(path) if is_there(spark, path) else spark.createDataFrame([], ATTEMPTS)


def to_attempt(targets: DataFrame, ledger: DataFrame, most: int = 3, excluded: DataFrame | None = None) -> DataFrame:
    """The targets (code, ...) that no attempt has settled and that weren't tried most times, with tries; those of excluded
    (code) go. A code is settled by one success, whatever came after."""
    seen = ledger.groupBy("code").agg(F.count("*").alias("tries"), F.max("ok").alias("_done"))
    open_ = targets.join(seen, "code", "left").where(~F.coalesce("_done", F.lit(False)) & (F.coalesce("tries", F.lit(0)) < most))
    open_ = open_.select(*targets.columns, F.coalesce("tries", F.lit(0)).alias("tries"))
    return open_ if excluded is None else open_.join(excluded.select("code").distinct(), "code", "left_anti")
