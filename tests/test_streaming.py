"""Streams with state and ledgers: late rows, stops and restarts, and batches that are run again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finloom.operators.events import event_study
from finloom.streaming import ledger as L
from finloom.streaming import stateful as T

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    held = spark.conf.get(T.STATE_STORE[0])
    spark.conf.set(*T.STATE_STORE)
    yield spark
    spark.conf.set(T.STATE_STORE[0], held)


def files(spark, folder, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_labels_become_final(rocks, tmp_path):
    rng = random.Random(3)
    at = lambda d: DAY + dt.timedelta(days=d)
    prices, events = [], []
    for key in "abc":
        days = [d for d in range(40) if rng.random() < 0.7]
        prices += [(key, at(d), None if rng.random() < 0.1 else rng.uniform(90, 110)) for d in days]
        events += [(key, f"{key}{i}", at(rng.randrange(30))) for i in range(12)]
    prices.sort(key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 40)))  # late by less than three days
    events.sort(key=lambda r: r[2])
    last = [(k, at(90), 1.0) for k in "abc"]
    cut = lambda rows, n: [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]
    schemas = "k string, day timestamp, close double", "k string, e string, d timestamp"
    expected = event_study(rocks.createDataFrame(events, schemas[1]), rocks.createDataFrame(prices, schemas[0]), "k", "e", "d", "day", "close")
    want = sorted((r["k"], r["e"], r["base_day"], r["end_day"], round(r["change"], 9), r["label"]) for r in expected.collect())

    def run(batches, where):
        p = files(rocks, tmp_path / where / "p", batches, schemas[0])
        e = files(rocks, tmp_path / where / "e", cut(events, 5), schemas[1])
        got = []
        q = T.final_labels(e, p, "k", "e", "d", "day", "close").writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / where / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return got, (e, p)

    first, (e, p) = run(cut(prices, 5), "x")
    assert len(first) < len(want)  # the last events' days aren't late past yet
    rocks.createDataFrame(last, schemas[0]).coalesce(1).write.parquet(str(tmp_path / "x" / "p" / "9"))
    more = []
    q = T.final_labels(e, p, "k", "e", "d", "day", "close").writeStream.foreachBatch(lambda df, _: more.extend(df.collect())).option("checkpointLocation", str(tmp_path / "x" / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["key"], r["event"], r["base_day"], r["end_day"], round(r["change"], 9), r["label"]) for r in [*first, *more])
    assert got == want and want and first


def test_answers_expire(rocks, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    batches = [[("a", at(0)), ("a", at(299)), ("b", at(10))], [("a", at(300)), ("a", at(301)), ("b", at(290))], [("b", at(1000)), ("a", at(5000))]]
    stream, got = files(rocks, tmp_path / "in", batches, "k string, t timestamp"), []
    q = T.expiring_answers(stream, "k", "t").writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    hits = {(r["key"], (r["at"] - DAY).seconds): r["hit"] for r in got}
    assert hits == {("a", 0): False, ("a", 299): True, ("b", 10): False, ("a", 300): False, ("a", 301): True, ("b", 290): True, ("b", 1000): False, ("a", 5000): False}


def test_batches_that_run_again(spark, tmp_path):
    path = str(tmp_path / "table")
    day = lambda d: dt.date(2024, 1, d)
    make = lambda rows: spark.createDataFrame(rows, "code string, day date, v int")
    one, two = make([("a", day(1), 1), ("a", day(1), 0), ("b", day(1), 2), ("a", day(2), 3)]), make([("a", day(1), 9), ("c", day(1), 4), ("a", day(3), 5)])
    rows = lambda: sorted((r["code"], r["day"].day, r["v"], r["batch"]) for r in spark.read.parquet(path).collect())
    L.append_batch(one, 0, path, ["code"], "day")
    L.append_batch(two, 1, path, ["code"], "day")
    want = [("a", 1, 0, 0), ("a", 2, 3, 0), ("a", 3, 5, 1), ("b", 1, 2, 0), ("c", 1, 4, 1)]
    assert rows() == want
    for again in (two, one):  # a batch is run again after a failure
        L.append_batch(again, 1 if again is two else 0, path, ["code"], "day")
        assert rows() == want
    L.append_batch(make([]), 2, path, ["code"], "day")
    assert rows() == want
    read = spark.read.parquet(path).where(F.col("day").isin([day(3)]) & (F.col("batch") != 7)).select("code", "day")
    assert "PartitionFilters: [isnotnull(day" in read._jdf.queryExecution().toString() or "PartitionFilters: [day" in read._jdf.queryExecution().toString()


def test_a_stopped_stream_goes_on(spark, tmp_path):
    schema, path = "code string, day date, v int", str(tmp_path / "table")
    rows = [[(f"c{i}", dt.date(2024, 1, 1 + i % 3), i) for i in range(10)], [(f"c{i}", dt.date(2024, 1, 1 + i % 3), i) for i in range(5, 15)]]
    stream = files(spark, tmp_path / "in", rows[:1], schema)
    L.keep(stream, path, str(tmp_path / "c"), ["code"], "day").awaitTermination()
    spark.createDataFrame(rows[1], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "later"))
    L.keep(stream, path, str(tmp_path / "c"), ["code"], "day").awaitTermination()
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [*range(15)]


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    targets = spark.createDataFrame([(c, i) for i, c in enumerate("abcde")], "code string, n int")
    left = lambda **more: sorted((r["code"], r["tries"]) for r in L.to_attempt(targets, L.attempts(spark, path), **more).collect())
    assert left() == [(c, 0) for c in "abcde"]
    schema = "code string, ok boolean, note string"
    L.record_attempts(spark.createDataFrame([("a", True, ""), ("b", False, "no panel")], schema), 1, path)
    L.record_attempts(spark.createDataFrame([("a", True, ""), ("b", False, "no panel")], schema), 1, path)  # run again
    assert left() == [("b", 1), ("c", 0), ("d", 0), ("e", 0)]
    for n in (2, 3):
        L.record_attempts(spark.createDataFrame([("b", False, "no panel"), ("a", False, "later")], schema), n, path)
    assert left(excluded=spark.createDataFrame([("d",)], "code string")) == [("c", 0), ("e", 0)] and left(most=9)[0] == ("b", 3)
