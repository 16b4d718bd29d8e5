"""The bootstrap interval of F1 against a plain version."""

import hashlib

import pytest

from finloom.operators import evaluation

#: The Poisson(1) distribution's sums.
SUMS = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]


def brute(truth, found, rounds, seed):
    chunks = {c for c, _ in truth | found}
    counts = {c: [len({x for x in s if x[0] == c}) for s in (truth & found, found - truth, truth - found)] for c in chunks}

    def f1(times):
        tp, fp, fn = (sum(times[c] * counts[c][i] for c in chunks) for i in range(3))
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    draw = lambda b, c: sum(int(hashlib.md5(f"{seed}:{b}:{c}".encode()).hexdigest()[:8], 16) / 2**32 >= s for s in SUMS)
    each = sorted(f1({c: draw(b, c) for c in chunks}) for b in range(1, rounds + 1))
    return [f1(dict.fromkeys(chunks, 1)), each[int(0.025 * rounds)], each[int(0.975 * rounds)]]


def test_small_table(spark):
    truth = {(c, i) for c in range(6) for i in range(4)}
    found = {(c, i) for c, i in truth if (c + i) % 3} | {(c, 9) for c in range(0, 8, 2)}
    table = lambda rows: spark.createDataFrame(sorted(rows), "c int, i int")
    got = evaluation.bootstrap_f1(table(truth), table(found), "c", 200, "s").collect()
    assert [tuple(r) for r in got] == [pytest.approx(brute(truth, found, 200, "s"))]
    assert [tuple(r) for r in evaluation.bootstrap_f1(table(truth).limit(0), table(found).limit(0), "c", 10, "s").collect()] == [(None, None, None)]


def test_direction_confusion(spark):
    schema = "chunk int, name string, d string, s string"
    truth = spark.createDataFrame([(1, "a", "buy", "on"), (1, "a", "buy", "off"), (1, "b", "sell", "on"), (2, "a", "buy", "on")], schema)
    found = spark.createDataFrame([(1, "a", "buy", "on"), (1, "b", "buy", "on"), (2, "a", "sell", "on"), (2, "a", "sell", "on"), (2, "c", "sell", "on"), (1, "a", "sell", "on")], schema)
    got = evaluation.direction_confusion(truth, found, ["chunk", "name"], ["d", "s"]).collect()
    assert [tuple(r) for r in got] == [("buy/on", "sell/on", 2), ("buy/off", "sell/on", 1), ("sell/on", "buy/on", 1)]


def test_direction_confusion_groups_rows_once(spark):
    """Rows with a null are never true; one join is left, that of wrong rows with true ones."""
    schema = "k long, d string, s string"
    truth = spark.createDataFrame([(1, "in", "a"), (1, "in", "a"), (1, "out", None), (2, "in", "a"), (None, "in", "a")], schema)
    found = spark.createDataFrame([(1, "in", "a"), (1, "out", "a"), (1, "out", "a"), (1, "out", None), (2, "in", "b"), (3, "in", "a"), (None, "in", "b")], schema)
    wrong = evaluation.direction_confusion(truth, found, ["k"], ["d", "s"])
    assert [tuple(r) for r in wrong.collect()] == [("in/a", "in/b", 1), ("in/a", "out", 1), ("in/a", "out/a", 1), ("out", "out", 1), ("out", "out/a", 1)]
    assert wrong._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
