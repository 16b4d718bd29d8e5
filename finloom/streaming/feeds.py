"""Feeds as Structured Streaming: at-least-once polls made exactly-once, bursts, latest state, rates, and sinks.

Batches and streams take the same functions where the work allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def polled_once(feed: DataFrame, key: str, seen_at: str, overlap: str = "7 days") -> DataFrame:
    """A feed polled with overlapping windows, each key once: repeats within overlap are dropped, state older than that
    is forgotten. A batch keeps the earliest row of each key."""
    if feed.isStreaming:
        return feed.withWatermark(seen_at, overlap).dropDuplicatesWithinWatermark([key])
    rest = [c for c in feed.columns if c != key]
    return feed.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(seen_at, *(F.col(c).cast("string") for c in rest))).alias("_r")).select(key, "_r.*").select(*feed.columns)


def daily_counts(feed: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """key, day (window) and n of each key's day; a stream gives a day once it is late past."""
    timed = feed.withWatermark(at, late) if feed.isStreaming else feed
    return timed.groupBy(key, F.window(at, "1 day").alias("day")).agg(F.count("*").alias("n")).select(key, F.col("day.start").alias("day"), "n")


def bursts(feed: DataFrame, key: str, at: str, most: int = 5) -> DataFrame:
    """The days of keys with more than most rows."""
    return daily_counts(feed, key, at).where(F.col("n") > most)


def newest(feed: DataFrame, key: str, year: str) -> DataFrame:
    """The newest year of each key so far (output mode update or complete)."""
    return feed.groupBy(key).agg(F.max(year).alias("newest"))


def in_market_hours(at: Column, opens: str = "09:00", closes: str = "15:30", zone: str = "Asia/Seoul") -> Column:
    """Whether a moment in UTC is a weekday's trading time in zone."""
    local = F.from_utc_timestamp(at, zone)
    return F.weekday(local).between(0, 4) & F.date_format(local, "HH:mm").between(opens, closes)


def admitted(requests: DataFrame, key: str, at: str, most: int = 20, seconds: float = 60.0, late: str = "1 minute") -> DataFrame:
    """key, at and ok: a request is admitted if fewer than most admitted ones of its key lie in the seconds before it.

    As refused ones don't count, each answer depends on those before, so a key's requests pass in order through a state
    of at most `most` moments. For streams; rows may come late by late, and a key's state ends that and an hour after
    its last request, by the time of the requests.
    """
    schema = StructType.fromDDL(f"{key} {requests.schema[key].dataType.simpleString()}, {at} timestamp, ok boolean")

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(at, kind="stable")
        ok = []
        for moment in rows[at]:
            t = moment.timestamp()
            held = [h for h in held if h > t - seconds]
            ok.append(len(held) < most)
            if ok[-1]:
                held.append(t)
        state.update((held,))
        state.setTimeoutTimestamp(max(int(rows[at].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame({key: keys[0], at: rows[at].to_numpy(), "ok": ok})

    timed = requests.withWatermark(at, late)
    return timed.groupBy(key).applyInPandasWithState(step, schema, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def event_stream(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
