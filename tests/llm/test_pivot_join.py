"""The index against a comparison of all pairs."""

import math
import random

import numpy as np
import pytest

from finloom.llm import pivot_join, queries
from finloom.llm.pivot_join import compared, described, link_vectors, roots, thinned, unit

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, cosine=0.93):
    """Sorted (vec_id, n_links, component_id, kept) of rows (vec_id, label, vector), and the number of links."""
    ok = [label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, label, v in rows]
    parent, n = [*range(len(rows))], [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    kinds = {}
    for i, (_, label, v) in enumerate(rows):
        if ok[i]:
            kinds.setdefault((label, len(v)), []).append(i)
    for own in kinds.values():
        u = np.array([np.array(rows[i][2]) / max(abs(x) for x in rows[i][2]) for i in own])
        u /= np.sqrt((u * u).sum(1))[:, None]
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= cosine, 1)), strict=True):
            n[own[a]] += 1
            n[own[b]] += 1
            parent[root(own[a])] = root(own[b])
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, n[i], low.get(root(i)), d == low.get(root(i))) for i, (d, *_) in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=str)


def near(rng, v, cosine):
    e = rng.normal(size=len(v))
    e -= (e @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * e / np.linalg.norm(e)


def test_parts():
    rng = np.random.default_rng(3)
    assert np.allclose((unit(np.array([[3e300, 4e300], [1e-300, 0], [0, 0]])) ** 2).sum(1), [1, 1, 0])
    v = unit(rng.normal(size=(300, 8)))
    t = thinned(np.concatenate([v, v]), 200, 0.93)
    c = t @ t.T - 2 * np.eye(len(t))
    assert c.max() < 0.93 and (v @ t.T >= 0.93 - 1e-12).any(1).all() or len(t) == 200
    codes, scale, lost, order = described(v, t)
    assert np.abs(v - codes * scale[:, None]).max() < 1e-4 and lost.max() < 1e-3
    assert (order == np.argsort(-(v @ t.T), axis=1, kind="stable")[:, : pivot_join.NEAR]).all()
    assert roots(7, np.array([1, 2, 5]), np.array([2, 4, 6])).tolist() == [0, 1, 1, 3, 1, 5, 5]
    assert roots(2, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1]


def test_a_pair_counts_in_one_list():
    rng = np.random.default_rng(5)
    v = unit(rng.normal(size=(400, 6)))
    codes, scale, lost, order = described(v, unit(rng.normal(size=(40, 6))))
    seen = {}
    for pivot in range(40):
        own = np.flatnonzero((order[:, :3] == pivot).any(1))
        x = pivot_join._List(own, np.ones(len(own)), codes[own] * scale[own][:, None], lost[own], order[own])
        i, j, p, q = compared(x, x, True, pivot, 3, 0.9)
        for a, b in [*zip(own[i], own[j], strict=True), *zip(own[p], own[q], strict=True)]:
            if v[a] @ v[b] >= 0.9:  # of those the codes can't tell
                seen[a, b] = seen.get((a, b), 0) + 1
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if v[a] @ v[b] >= 0.9 and {*order[a, :3].tolist()} & {*order[b, :3].tolist()} and len({*order[a].tolist()} & {*order[b].tolist()}) >= 2}
    assert seen == dict.fromkeys(want, 1) and want


@pytest.mark.parametrize("block", [pivot_join.BLOCK_ROWS, 7])
def test_cases(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_join, "BLOCK_ROWS", block)
    rng, pick = np.random.default_rng(1), random.Random(1)
    rows = []
    for g in range(40):
        seed = unit(rng.normal(size=(1, 24)))[0]
        label = pick.choice([1, 2, 3])
        rows += [(g * 10 + k, label, (near(rng, seed, pick.choice([0.9995, 0.99, 0.98])) * pick.choice([1, 1e-200, 1e200])).tolist()) for k in range(pick.randrange(1, 10))]
    rows += [(1000 + i, 2, near(rng, np.eye(24)[0], 0.985).tolist()) for i in range(60)]  # a list longer than a block of 7
    rows += [(2000, 1, rows[0][2]), (2001, 2, rows[0][2]), (2002, None, rows[0][2]), (2003, None, rows[0][2]), (rows[0][0], rows[0][1], rows[0][2]), (None, 3, [1.0] * 24), (None, 3, [2.0] * 24)]
    rows += [(3000, 1, None), (3001, 1, []), (3002, 1, [0.0] * 24), (3003, 1, [float("nan")] * 24), (3004, 1, [None] + [1.0] * 23), (3005, 1, [1.0] * 23), (3006, 1, [float("inf")] * 24), (3007, 1, [1.0] * 23)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA + ", near string, n_links int").repartition(3)
    assert result(link_vectors(df, pivots=8, posts=8)) == brute(rows)
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert result(link_vectors(df.where("vec_id >= 3000 AND vec_id <> 3005 AND vec_id <> 3007"))) == [(i, 0, i, True) for i in (3000, 3001, 3002, 3003, 3004, 3006)]


def test_pairs_near_the_limit(spark):
    """The codes can't tell 0.93 from a little less: the vectors themselves decide."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(60):
        seed = unit(rng.normal(size=(1, 16)))[0]
        rows += [(2 * g, 1, seed.tolist()), (2 * g + 1, 1, near(rng, seed, 0.93 + (-1) ** g * 1e-7).tolist())]
    got = link_vectors(spark.createDataFrame(rows, SCHEMA), pivots=4, posts=4)
    assert result(got) == brute(rows)


@pytest.mark.parametrize("cosine, least", [(0.935, 0.9), (0.95, 0.93), (0.98, 0.98)])
def test_recall(spark, cosine, least):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(1500):
        seed = unit(rng.normal(size=(1, 64)))[0]
        rows += [(2 * g, g % 3, seed.tolist()), (2 * g + 1, g % 3, near(rng, seed, cosine).tolist())]
    got = result(link_vectors(spark.createDataFrame(rows, SCHEMA)))
    links, want = sum(r[1] for r in got), sum(r[1] for r in brute(rows))
    assert least * want <= links <= want


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got, want = result(queries.QUERIES["op11_embedding_dedup"](spark, folder)), brute(rows)
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
