"""The join against a comparison of all pairs of sets."""

import random
import re
from collections import Counter

import pytest

from finloom.llm import queries
from finloom.llm.ngram_join import link_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = [*range(len(docs))]

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("rounds", [0, 3])
def test_cases(spark, rounds):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Zé", "zé", "ß"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [(900, None), (901, None), (902, ""), (903, " \n"), (904, "a b"), (905, "A  b"), (906, "a b c"), (None, "x y z"), (None, "X y z"), (None, None)]
    common = words(60)
    for base in range(8):
        seed = words(rng.choice([8, 30, 60, 120]))
        for k in range(12):
            w = list(seed)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((base * 50 + k, " ".join(w if k % 4 else w + common)))
    docs += [(500 + i, docs[20][1].upper()) for i in range(5)] + [docs[30], docs[30], (30_000, " ".join(words(20_000)))]
    got = link_near_duplicates(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(3), leader_rounds=rounds)
    assert result(got) == brute(docs)


def test_empty(spark):
    assert link_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert result(queries.QUERIES["op5_ngram_jaccard_join"](spark, folder)) == want
    assert any(d != c for d, _, c in want)
