"""Mixing: targets by hand, permutations, and of the mix its totals, bounds and texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from finloom.llm import queries
from finloom.llm.mixing import mix_sources, mixed_documents, permuted, shard_counts, taken_words, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert targets([100, 100, 100], [1, 1, 1], 1.5, 2) == [150, 150, 150]
    assert targets([10, 1000], [3, 1], 1.0, 2) == [20, 990]
    assert targets([10, 20, 1000, 0], [3, 3, 1, 9], 1.0, 2) == [20, 40, 970, 0]
    assert targets([], [], 1.5, 2) == [] and targets([0], [1], 1.5, 2) == [0]


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(permuted(np.arange(n), n, 7)) == [*range(n)]
    assert permuted(np.arange(1000), 1000, 1).tolist() != permuted(np.arange(1000), 1000, 2).tolist() != [*range(1000)]


def test_draws():
    slots = [1000, 10, 0, 333]
    got = [*shard_counts(slots, 100, 3, 0, 99)]
    assert [k for k, *_ in got] == [*range(14)] and [int(c.sum()) for _, c, _ in got] == [100] * 13 + [43]
    assert sum(c for _, c, _ in got).tolist() == slots
    for (_, counts, first), (_, _, onward) in zip(got, got[1:], strict=False):
        assert (first + counts == onward).all()
    for low in (0, 4, 13):  # a task that draws some shards alone finds the same
        for (k, c, f), (m, d, g) in zip(got[low : low + 3], shard_counts(slots, 100, 3, low, low + 3), strict=True):
            assert k == m and (c == d).all() and (f == g).all()
    assert [*shard_counts([], 5, 1, 0, 9)] == [] and [*shard_counts([0], 5, 1, 0, 9)] == []
    shares = np.array([c[0] for _, c, _ in shard_counts([10_000, 30_000], 100, 8, 0, 400)])
    assert abs(shares.mean() - 25) < 0.1 and 3 < shares.std() < 6  # of 100 draws at a quarter: 4.3


def totals(docs, rows):
    order = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += len(WORD.findall(t or ""))
    return dict(zip(order, zip((sizes[s] for s in order), targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2), strict=True), strict=True))


def check(docs, rows, block):
    want, source = totals(docs, rows), {}
    for d, s, _ in docs:
        source[d] = s
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d), len(WORD.findall(t or ""))) for d, _, t in docs)
    taken = Counter()
    for r in rows:
        size, target = want[source[r["doc_id"]]]
        assert r["source_size"] == size and r["target"] == pytest.approx(target) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= 2 * block, (s, taken[s], target)


def test_cases(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["b", "é", "a", None, "Z"]), " ".join(f"w{i}_{k}" for k in range(rng.randrange(200)))) for i in range(150)]
    docs += [(None, "a", "null id here"), (400, "tiny", "x y"), (401, "none", ""), (402, "none", None), (403, None, " \n "), (404, "a", "r e p"), (404, "a", "r e p"), (404, "a", "")]
    df = spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, source string, text string, number string").repartition(3)
    mix = mix_sources(df, block_words=8, shard_blocks=50)
    rows = taken_words(mix).collect()
    check(docs, rows, 8)
    again = taken_words(mix_sources(df.repartition(2), block_words=8, shard_blocks=50)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    shards = Counter(r["shard"] for r in mix.taken.select("shard", "number", "j").distinct().collect())
    assert all(shards[k] == 50 for k in range(max(shards)))
    texts = mixed_documents(df.drop("number"), mix).collect()
    assert sum(len(WORD.findall(r["text"])) for r in texts) == sum(r["taken"] for r in rows)
    held = {d: WORD.findall(t or "") for d, _, t in docs}
    assert all(set(WORD.findall(r["text"])) <= set(held[r["doc_id"]]) for r in texts if r["doc_id"] != 404)
    assert mixed_documents(df, mix).columns == [*df.columns, "n_chars"][: len(df.columns)]


def test_empty(spark):
    assert taken_words(mix_sources(spark.createDataFrame([], "doc_id long, source string, text string"))).collect() == []


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text").collect()]
    check(docs, queries.op1_mix_sources(spark, "/root/testdata/sf0.01").collect(), 128)


def test_texts_and_clashing_columns(spark):
    rng = random.Random(4)
    gap = lambda: "".join(rng.choice(" \n\t x") for _ in range(rng.randrange(3))) + " "
    docs = [(i, "s", gap() + "".join(f"é{i}_{k}" + gap() for k in range(rng.randrange(1, 90)))) for i in range(60)]
    extra = ("spans", "_h", "h", "copy", "row", "nth", "id", "mixed", "g", "number", "block", "part")
    df = spark.createDataFrame([(*d, *range(len(extra)), 0) for d in docs], "doc_id long, source string, text string, " + ", ".join(f"{c} int" for c in extra) + ", n_chars int").repartition(3)
    mix = mix_sources(df, block_words=8, shard_blocks=50)
    spans = {}
    for r in mix.taken.collect():
        spans.setdefault((r["doc_id"], r["round"]), []).append((r["from_word"], r["n_words"]))
    held = {d: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t) for d, _, t in docs}
    want = sorted((d, "".join("".join(held[d][a : a + n]) for a, n in sorted(s))) for (d, _), s in spans.items())
    got = mixed_documents(df, mix)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == want
    assert all([r[c] for c in extra] == [*range(len(extra))] and r["n_chars"] == len(r["text"]) for r in rows)


def test_one_text_in_several_sources(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = [(1, "a", text, "x"), (1, "b", text, "y"), (1, "b", text, "z"), *((i, "ab"[i % 2], " ".join(f"w{i}_{k}" for k in range(50)), "x") for i in range(2, 14))]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, lang string").repartition(3)
    mix = mix_sources(df, block_words=8, shard_blocks=50)
    taken = {s: sum(r["n_words"] for r in mix.taken.where(f"number = {n}").collect()) for n, s in enumerate("ab")}
    got = mixed_documents(df, mix).collect()
    words = Counter()
    for r in got:
        words[r["source"]] += len(WORD.findall(r["text"]))
        assert Counter(WORD.findall(r["text"])).most_common(1)[0][1] == 1  # a row has words of one copy in one round
    assert words == taken
    again = mixed_documents(df, mix_sources(df.repartition(2), block_words=8, shard_blocks=50)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
