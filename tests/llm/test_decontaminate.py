"""Benchmark hits against a search of every window at every word."""

import hashlib
import re

from finloom.llm import queries
from finloom.llm.decontaminate import benchmark_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, size):
    held = {}
    for item_id, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            held.setdefault(tuple(w[i : i + size]), set()).add("" if item_id is None else str(item_id))
    sizes = {len(k) for k in held}
    out = []
    for doc_id, text in docs:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := held.get(tuple(w[i : i + n])):
                    ids |= found
                    hit |= {*range(i, i + n)}
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return out


def test_cases(spark):
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short Item!"), (11, None), (3, "?!"), (None, "é1 ß-x"), (4, "short item")]
    docs = [
        (0, "x ONE two-three four five six seven eight nine ten. eleven y"), (1, "one two three four five six seven eight nine"), (2, "a short\n item, short item"),
        (3, None), (4, ""), (5, "shorty item short items"), (6, "..É1 é1 ß  X.."), (None, "short item"), (7, "short item"), (7, "short item"), (8, "漢字 short_item 漢字"),
        (9, "w " * 30_000 + "two three four five six seven eight nine ten eleven"),
    ]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, item_id string").repartition(2)
    b = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc_id string")
    got = benchmark_hits(d, b).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got], key=key) == sorted(brute(docs, items, 10), key=key)
    texts = dict(docs)
    for r in got:
        assert sum(len(WORD.findall(lower(texts[r["doc_id"]][s["start"] : s["end"]]))) for s in r["spans"]) == r["n_hit"]
    assert [s.asDict() for s in next(r for r in got if r["doc_id"] == 8)["spans"]] == [{"start": 3, "end": 13}]
    empty = benchmark_hits(d, b.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r["n_hit"] for r in empty)
    assert benchmark_hits(d.limit(0), b).collect() == []


def test_parts(spark):
    many = " ".join(f"w{i}" for i in range(60))
    items = [(1, many), (2, "short Item!"), (None, "é1 ß-x"), (4, "short item"), (5, None), (6, "w3 w4 w5 w6 other"), (7, "w7 w8 w9 w10")]
    docs = [(0, "x " + many.upper() + " y"), (1, "a short\n item, w3 w4 w5 w6 w7 w8 w9 w10"), (2, None), (3, ""), (None, "..É1 é1 ß  X.."), (4, "w58-w59"), (5, "w20 w21 w22 w23"), (5, "w20 w21 w22 w23")]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, lang string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: str(r)
    whole = benchmark_hits(d, b, 4).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in whole], key=key) == sorted(brute(docs, items, 4), key=key)
    assert sorted(benchmark_hits(d, b, 4, most_bytes=40).collect(), key=key) == sorted(whole, key=key)
    carried = benchmark_hits(d, b, 4, most_bytes=40, carry=True)
    assert sorted([tuple(r) for r in carried.select("row.*").collect()], key=key) == sorted([(*x, "k") for x in docs], key=key)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op8_decontaminate(spark, folder).collect()}
    want = brute(docs, items, 10)
    assert sum(w[2] > 0 for w in want) > 0
    for doc_id, n, hit, ids in want:
        assert got[doc_id].asDict() == {"doc_id": doc_id, "n_words": n, "n_hit": hit, "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "contaminated": hit > 0}
