"""Substring dedup against a search of every window in every document."""

import hashlib
import random
import re

import pytest

from finloom.llm import queries
from finloom.llm.substrings import COVER, PERIOD, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=13):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    rank = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), rank(d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < rank(d) for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == {*range(PERIOD)}


def test_cases(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("ab cd ef gh ij kl mn op qr é ß".split()) + str(rng.randrange(40)) for _ in range(n)]
    passages = [words(n) for n in (13, 14, 20, 60, 12)]
    docs = [(None, None), (0, ""), (1, "  \n "), (2, "a b"), (None, " ".join(passages[3])), (None, " ".join(passages[3]))]
    for d in range(3, 60):
        t = []
        for _ in range(rng.randrange(1, 4)):
            t += words(rng.randrange(30)) + rng.choice(passages)[: rng.randrange(10, 61)]
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(t)))
    docs += [(7, docs[9][1]), (7, docs[9][1]), (70, docs[9][1]), (71, "x " * 30_000), (72, "x " * 14)]
    got = remove_repeats(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, chunk string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute(docs)
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 7)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op10_substring_dedup"](spark, folder).collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs)]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
