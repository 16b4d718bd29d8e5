"""The lattice against a sum over all segmentations; counts and base scores against a plain version."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from finloom.llm import queries
from finloom.llm.lattice_lm import Lattice, score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_all_segmentations():
    lattice = Lattice({"▁a": 5, "▁ab": 3, "▁": 2, "b": 4, "bc": 2, "c": 1, "abc": 1, "<0xC3>": 2, "<s>": 9, "é": 3, "cab": 2})

    def paths(w):
        if not w:
            return 1.0
        return sum(math.exp(lattice.later[w[:k]]) * paths(w[k:]) for k in range(1, len(w) + 1) if w[:k] in lattice.later)

    def total(w):
        return math.log(sum(math.exp(s) * paths(w[len(p) :]) for p, s in lattice.first.items() if w.startswith(p))) + lattice.end

    words = ["a", "ab", "abc", "abcab", "é", "xyz", "éab", "cabcabcab", "zzz"]
    got = lattice.words([w.encode() for w in words])
    for w, x in zip(words, got, strict=True):
        assert x == pytest.approx(total(w.encode()), abs=1e-9) and lattice.word(w.encode()) == pytest.approx(x, abs=1e-9), w
    long = [b"abc" * 60, b"abc", b"abc" * 10]
    assert lattice.words(long)[0] == pytest.approx(lattice.word(long[0])) and lattice.words(long)[2] == pytest.approx(lattice.word(long[2]))
    assert len(lattice.words([])) == 0


def test_mass():
    lattice = Lattice({k: 10**6 * n for k, n in {"▁a": 5, "▁ab": 3, "▁": 2, "b": 4, "bb": 2, "a": 1}.items()})
    words = [bytes(w) for n in range(1, 13) for w in itertools.product(b"ab", repeat=n)]
    assert 0.5 < np.exp(lattice.words(words)).sum() < 1
    few = Lattice({"▁a": 10**9, "a": 10**8})  # nearly all mass is on runs of a
    assert 0.95 < np.exp(few.words([b"a" * n for n in range(1, 200)])).sum() <= 1


def test_text_is_words_and_end(spark):
    docs = spark.createDataFrame([(i, "a b a") for i in range(50)] + [(99, "a"), (100, None), (101, "b a")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, MODEL, F.col("doc_id") >= 99).collect()}
    end = (50 + 1) / (50 * 4 + 2)
    assert got[100] == pytest.approx(math.log10(end))
    a, b = got[99] - got[100], got[101] - got[99]
    assert got[0] == pytest.approx(2 * a + b + got[100]) and 10**a + 10**b < 1 - end


def check(docs, got, held):
    train = Counter(t for d, text in docs if not held(d) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    rows = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], r["base_score"]) for r in got), key=str)
    want = sorted(((d, len(t := tokens(text)), sum(train[x] > 0 for x in t), n, held(d), sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t)) for d, text in docs), key=str)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_cases(spark):
    docs = [(1, "The cat the Cat"), (2, None), (3, ""), (4, "unseen wörd 漢字"), (5, "the cat\nsat"), (5, "the cat\nsat"), (None, "x"), (7, "a" * 5000), (8, "the " * 30_000)]
    held = lambda d: d in (4, 2)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    check(docs, score_texts(df, MODEL, F.col("doc_id").isin(4, 2)).collect(), held)
    assert score_texts(df.limit(0), MODEL, F.lit(False)).collect() == []
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in score_texts(df, MODEL, F.lit(True)).collect())


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op7_lm_scores"](spark, "/root/testdata/sf0.01").collect()
    check(docs, got, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    # of a held-out text, the model tells it from the same letters in another order in each word, and spells it shorter
    rng, texts = random.Random(3), dict(docs)
    held = {r["doc_id"]: r for r in got if r["held_out"] and r["n_tokens"] > 20}
    mixed = [(d, " ".join("".join(rng.sample(w, len(w))) for w in texts[d].lower().split())) for d in held]
    both = spark.createDataFrame([(d, t, False) for d, t in docs if d not in held] + [(d, t, True) for d, t in mixed], "doc_id long, text string, out boolean")
    other = {r["doc_id"]: r for r in score_texts(both, MODEL, F.col("out")).where("held_out").collect()}
    assert sum(held[d]["score"] > other[d]["score"] for d in held) > 0.99 * len(held)
    bits = [-r["score"] * math.log2(10) / len(texts[d].encode()) for d, r in held.items()]
    assert 0 < sum(bits) / len(bits) < 4
