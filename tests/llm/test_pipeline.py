"""Each stage of the pipeline on its own input, against plain versions."""

import re
from collections import Counter

import corpus_pipeline as p

from finloom.llm.storage import written

from .test_decontaminate import brute as hits
from .test_mixing import WORD, totals
from .test_ngram_join import brute as components

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34 !!", "en", "src0", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    docs = docs.union(odd)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        out = stage(spark, docs, FOLDER)
        if k < 4:
            assert out.columns == docs.columns
        out = written(out, f"test-{k}")
        rows = out.collect()
        ids = sorted(r["doc_id"] for r in rows)
        if k == 0:
            assert ids == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        elif k == 1:
            assert ids == sorted(d for d, _, c in components([(r["doc_id"], r["text"]) for r in before]) if d == c)
        elif k == 2:
            assert ids == sorted(d for d, _, n, _ in hits([(r["doc_id"], r["text"]) for r in before], items, 10) if not n)
        elif k == 3:
            want, taken = totals([(r["doc_id"], r["source"], r["text"]) for r in before], None), Counter()
            texts = {r["doc_id"]: WORD.findall(r["text"]) for r in before}
            for r in rows:
                words = WORD.findall(r["text"])
                assert len(r["text"]) == r["n_chars"] and Counter(words) <= Counter(texts[r["doc_id"]])
                taken[r["source"]] += len(words)
            assert all(abs(taken[s] - t) <= 256 for s, (_, t) in want.items()) and max(Counter(ids).values()) == 2
        else:
            assert ids == sorted(r["doc_id"] for r in before) and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
        docs = out


def test_one_row_of_each_component(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [
        (None, a, "s1"), (None, a, "s2"), (None, a + " more", "s3"),  # copies without ids: one stays
        (5, b, "s1"), (5, b, "s1"), (5, b, "s2"),  # one id, repeated rows: one stays
        (7, c, "s1"), (8, c, "s1"), (8, "quite another text with words of its own", "s1"),  # the copy of 7 goes, not the other text under 8
        (None, "alone", "s1"), (None, None, "s1"), (9, "", "s1"), (9, "", "s1"), (9, None, "s1"),  # nothing links with these
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = p.near_duplicates(spark, docs, FOLDER)
    assert got.columns == docs.columns
    got = sorted(got.select("doc_id", "text").collect(), key=str)
    kept = [r for r in got if (r["text"] or "")[:3] == "a0 "]
    assert len(kept) == 1 and kept[0]["doc_id"] is None
    rest = [tuple(r) for r in got if r not in kept]
    want = [(5, b), (7, c), (8, "quite another text with words of its own"), (None, "alone"), (None, None), (9, ""), (9, ""), (9, None)]
    assert sorted(rest, key=str) == sorted(want, key=str)


def test_null_id_gives_way(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (4, text), (3, text + " x")], "doc_id long, text string")
    assert [r["doc_id"] for r in p.near_duplicates(spark, docs, FOLDER).collect()] == [3]


def test_run(spark):
    assert p.run(spark, FOLDER).count() > 0 and [n for n, _ in p.STAGES] and all(re.match("[a-z]", n) for n, _ in p.STAGES)
