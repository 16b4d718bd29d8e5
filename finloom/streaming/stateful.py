"""Streams with state of their own: labels of events that become final as prices arrive, and answers that expire.

Both are keyed state machines of Structured Streaming (RocksDB state, timers on the watermark), so a stopped query goes on
from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.numbers import return_label

#: The state store that keyed state machines need: set it in the session before such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(moment: datetime) -> int:
    return round(moment.replace(tzinfo=moment.tzinfo or timezone.utc).timestamp() * 1000)


class _Labels(StatefulProcessor):
    """Open events of a key and the prices that they, or events still to come, may need."""

    def __init__(self, days: int, within: int):
        self.days, self.within = days, timedelta(days=within)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices = handle.getMapState("prices", "day timestamp", "close double")
        self.events = handle.getMapState("events", "event string", "day timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for event, day, close in zip(frame["event"], frame["day"], frame["close"], strict=True):
                if pd.notna(event):
                    self.events.updateValue((event,), (day.to_pydatetime(),))
                elif pd.notna(close):
                    self.prices.updateValue((day.to_pydatetime(),), (float(close),))
        yield from self._final(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._final(key, timerValues.getCurrentWatermarkInMs())

    def _final(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """The events whose last price can't change: no row of its day or before is taken any more."""
        prices = sorted((d, c) for (d,), (c,) in self.prices.iterator())
        done, open_days = [], []
        for (event,), (day,) in list(self.events.iterator()):
            later = [i for i, (d, _) in enumerate(prices) if day < d <= day + self.within]
            end = later[0] + self.days if later else None
            wait = day + self.within if not later else prices[end][0] if end < len(prices) else None
            if wait is not None and _ms(wait) <= watermark:
                self.events.removeKey((event,))
                if later:
                    done.append((*key, event, *prices[later[0]], *prices[end]))
                continue
            open_days.append(day)
            if wait is not None:
                self.handle.registerTimer(_ms(wait) + 1)
        kept = min([*map(_ms, open_days), watermark])
        for d, _ in prices:
            if _ms(d) <= kept:
                self.prices.removeKey((d,))
        if done:
            yield pd.DataFrame(done, columns=["key", "event", "base_day", "base_close", "end_day", "end_close"])

    def close(self) -> None:
        pass


def final_labels(events: DataFrame, prices: DataFrame, key: str, event: str, event_day: str, day: str, close: str, days: int = 5, within: int = 7, late: str = "3 days") -> DataFrame:
    """events.event_study() of two streams: key, event, base_day, base_close, end_day, end_close, change and label of an event
    once the days-th priced day after its base is late past, so that rows that come late by less still count. An event
    without a price within days after it gets none. One close for each key and day.

    A key's state holds its open events and the prices after the first of these; what is older than the watermark and no
    open event needs is removed.
    """
    kind = "key string, event string, day timestamp, close double"
    asked = events.select(F.col(key).cast("string").alias("key"), F.col(event).cast("string").alias("event"), F.col(event_day).cast("timestamp").alias("day"), F.lit(None).cast("double").alias("close"))
    priced = prices.where(F.col(close).isNotNull()).select(F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("event"), F.col(day).cast("timestamp").alias("day"), F.col(close).cast("double").alias("close"))
    both = asked.unionByName(priced).withWatermark("day", late)
    schema = "key string, event string, base_day timestamp, base_close double, end_day timestamp, end_close double"
    assert [f.split(" ")[0] for f in kind.split(", ")] == both.columns
    out = both.groupBy("key").transformWithStateInPandas(_Labels(days, within), schema, "Append", "EventTime")
    change = F.try_divide(F.col("end_close"), F.col("base_close")) * 100 - 100
    return out.withColumn("change", change).withColumn("label", return_label("change"))


class _Answers(StatefulProcessor):
    """When a key's answer was fetched last."""

    def __init__(self, seconds: float):
        self.life = timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched", "at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = sorted(m.to_pydatetime() for frame in rows for m in frame["at"])
        held = self.fetched.get()[0] if self.fetched.exists() else None
        out = []
        for moment in at:
            hit = held is not None and held <= moment < held + self.life
            if not hit:
                held = moment
            out.append((*key, moment, hit))
        self.fetched.update((held,))
        self.handle.registerTimer(_ms(held + self.life))
        yield pd.DataFrame(out, columns=["key", "at", "hit"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.fetched.exists() and _ms(self.fetched.get()[0] + self.life) <= timerValues.getCurrentWatermarkInMs():
            self.fetched.clear()
        return iter([])

    def close(self) -> None:
        pass


def expiring_answers(requests: DataFrame, key: str, at: str, seconds: float = 300.0, late: str = "1 minute") -> DataFrame:
    """key, at and hit of each request of a stream: whether an answer fetched less than seconds before serves it; else it is
    fetched anew. Requests of a batch count in order of time; one that comes after a later one's fetch and lies before it is
    fetched itself. A key's state ends when its answer has expired by the time of the requests."""
    asked = requests.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    return asked.groupBy("key").transformWithStateInPandas(_Answers(seconds), "key string, at timestamp, hit boolean", "Append", "EventTime")
