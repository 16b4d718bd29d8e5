"""Codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from finloom.llm import queries, vector_codes
from finloom.llm.vector_codes import Filtered, Tree, compress_vectors


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, label, code, error) of rows (vec_id, vector, label), and the codebooks, by comparing every part with every entry."""
    kept = [(d, [math.floor(1024 * x) for x in v], label) for d, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    w = len(kept[0][1]) // parts
    cut = np.array([v for _, v, _ in kept], object).reshape(len(kept), parts, w)
    books = [[list(x) for x in cut[:entries, p]] for p in range(parts)]

    def nearest(p):
        book = np.array(books[p], object)
        far = ((cut[:, p, None, :] - book[None]) ** 2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        for p in range(parts):
            to, _ = nearest(p)
            for e in set(to.tolist()):
                own = cut[to == e, p]
                books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    found = [nearest(p) for p in range(parts)]
    out = [(d, label, "".join(f"{int(found[p][0][i]):02x}" for p in range(parts)), int(sum(found[p][1][i] for p in range(parts)))) for i, (d, _, label) in enumerate(kept)]
    return sorted(out, key=str), books


def digest(books):
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33, 1000])
@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_filter(n, kind):
    rng = np.random.default_rng(n)
    points = rng.integers(-9, 9, (n, 3))  # few values: many ties
    tree = Tree.of(points)
    again = Tree.unpacked(tree.packed(), 3)
    book = points[rng.integers(0, n, 12)]
    far = ((points[:, None] - book[None]) ** 2).sum(2)
    want = far.argmin(1)
    for t in (tree, again):
        found = Filtered(t, book, kind)
        got = np.empty(n, np.int64)
        got[t.order] = found.entry
        assert (got == want).all() and found.counts.tolist() == np.bincount(want, minlength=12).tolist()
        assert (found.sums == np.stack([points[want == e].sum(0) for e in range(12)])).all()
    if n == 1000:
        assert found.whole > 0  # subtrees were assigned at once


def test_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (2000, 4)) + 1000 * k for k in range(8)])
    assert Filtered(Tree.of(points), np.array([[25 + 1000 * k] * 4 for k in range(8)]), np.float64).whole == len(points)


@pytest.mark.parametrize("largest", [1.0, 60_000.0])
def test_cases(spark, monkeypatch, largest):
    rng = random.Random(7)
    rows = [(i * 3 % 400, [largest * rng.choice([rng.uniform(-1, 1), 0.25, -0.5]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [rows[5], rows[5], (None, rows[6][1], 1), (-1, None, 1), (-2, [None] * 8, 1), (-3, [float("nan")] + [0.0] * 7, 2), (-4, [float("inf")] + [0.0] * 7, 2), (-5, [0.0] * 8, None), (-6, [-0.0] * 8, 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, points_0 int").repartition(3)
    got = compress_vectors(df, ["label", "code"])
    want, books = plain(rows)
    assert [c for c in got.vectors.columns] == ["vec_id", "label", "code", "code", "error"]
    assert sorted(((r[0], r[1], r[3], r[4]) for r in got.vectors.collect()), key=str) == want
    assert got.digest() == digest(books)
    few = compress_vectors(df, ["label"], entries=5, rounds=2)
    want, books = plain(rows, entries=5, rounds=2)
    assert sorted((tuple(r) for r in few.vectors.collect()), key=str) == want and few.digest() == digest(books)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert compress_vectors(spark.createDataFrame([], schema)).vectors.collect() == []
    assert compress_vectors(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0] * 3, 2)], schema)).vectors.collect() == []
    lengths = spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (3, [2.0] * 4, 2), (4, [1e30] * 4, 2)], schema)
    assert [(r["vec_id"], r["error"]) for r in compress_vectors(lengths).vectors.orderBy("vec_id").collect()] == [(1, 0), (3, 0)]
    with pytest.raises(ValueError):
        compress_vectors(lengths, entries=300)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = plain(rows)
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    got = sorted((tuple(r) for r in queries.QUERIES["op12_vector_codes"](spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == sorted(((d, c, e, totals[label], digest(books)) for d, label, c, e in want), key=str)
