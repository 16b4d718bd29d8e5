"""Small cases of operators that the given tables don't show: nulls, ties, boundaries, layouts and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from finloom.functions import numbers as N
from finloom.functions import texts as X
from finloom.operators import chunks, earnings, events, keyed, relations, statements, tables
from finloom.sources import files
from finloom.streaming import feeds, ledger


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_numbers(spark):
    lit = lambda v: F.lit(v).cast("double")
    score = lambda v: N.piecewise(lit(v), ((0, 0), (10, 50), (10, 60), (20, 100)))
    got = one(spark, a=score(-1), b=score(5), c=score(10), d=score(15), e=score(99), f=score(None), g=N.ratio(F.lit(1), F.lit(0)), h=N.grade(lit(75)), i=N.grade(lit(None)), j=N.ownership(lit(50)), k=N.ownership(lit(50.1)), l=N.ownership(lit(4.9)))
    assert got == {"a": 0, "b": 25, "c": 50, "d": 80, "e": 100, "f": None, "g": None, "h": "A", "i": None, "j": "associate", "k": "subsidiary", "l": None}
    texts = {"1,234.5": 1234.5, "(1,234)": -1234, "△5": -5, "-": None, "": None, "-7": -7, " 12 ": 12, "abc": None, "(1,234": None, "<b>7</b>": 7, "&nbsp;3": 3, "−8": -8, "▵(9)": None, "(△4)": -4, "—": None, "1.": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.amount("t").alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == texts
    got = one(spark, a=N.won_amount(F.lit("1,210.2조")), b=N.won_amount(F.lit("350억")), c=N.won_amount(F.lit("x")), d=N.won_label(lit(1.5e12)), e=N.won_label(lit(3e8)), f=N.cagr(lit(1), lit(4), 2.0), g=N.cagr(lit(-1), lit(4), 2.0), h=N.peer_score(lit(3), F.array(*map(lit, (1, 2, 3, 4, 5)))), i=N.peer_score(lit(9), F.array(*map(lit, (1, 2, 3, 4, 5))), False))
    assert got == {"a": 1210.2e12, "b": 350e8, "c": None, "d": "1.5조", "e": "3억", "f": 1.0, "g": None, "h": 50, "i": 0}


def test_texts(spark):
    names = {"(주)한빛 Co., Ltd.": "한빛", "Acme Inc": "acme", "주식회사 가나다*": "가나다", "CO": "", None: None, "Acme Holdings Limited": "acmeholdingslimited", "한화오션 주식회사(주1)": "한화오션", "㈜포스코퓨처엠(구, ㈜포스코케미칼)": "포스코퓨처엠", "위츠(비상장)": "위츠", "DB(Philippines) Inc.": "db(philippines)", "삼성전자(주)": "삼성전자"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.normal_name("n").alias("v")).collect()
    assert {r["n"]: r["v"] for r in rows} == names
    got = one(spark, a=X.short_latin_name(F.lit(" LG ")), b=X.short_latin_name(F.lit("Samsung")), c=X.group_head(F.lit("가나와 그 종속기업")), d=X.group_head(F.lit("가나")), e=X.slug(F.lit("  A b--C! ")), f=X.first_match(F.lit("정정 공시"), (("공시", "1"), ("정정", "2"))), g=X.sign_pattern(F.lit(1), F.lit(-1), F.lit(0)), h=X.hits(F.lit("ab cd"), ["ab", "x", "d"]))
    assert got == {"a": True, "b": False, "c": "가나", "d": None, "e": "a-b-c", "f": "1", "g": "+-0", "h": 2}


def test_keyed(spark):
    rows = spark.createDataFrame([(1, 5, "ended"), (1, 4, "active"), (2, 3, "active"), (None, 1, "active")], "k int, y int, status string")
    assert {r["k"] for r in keyed.latest_then(rows, ["k"], [F.desc("y")], F.col("status") == "active").collect()} == {2, None}
    assert {r["k"] for r in keyed.absent(rows, rows.where("k = 1"), ["k"]).collect()} == {2, None}
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "c", None)], "a string, b string, r double")
    assert sorted((r["a"], r["b"]) for r in keyed.undirected(edges, "a", "b", [], [F.desc_nulls_last("r")]).collect()) == [("a", "c"), ("b", "a")]
    nodes, kept = keyed.pruned(spark.createDataFrame([("a",), ("b",), ("z",)], "n string"), edges, "n", "a", "b")
    assert {r["n"] for r in nodes.collect()} == {"a", "b"} and kept.count() == 2
    assert keyed.filled(rows, rows.where("k = 2").select("k", "y"), ["k"], {"y": 0}).count() == 3
    assert [r["state"] for r in keyed.compared(rows.where("k = 1").limit(0), rows.where("k = 2"), ["k"]).collect()] == ["added"]


def test_events(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    prices = spark.createDataFrame([("a", day(n), None if n == 3 else 100.0 + n) for n in (0, 1, 2, 3, 8, 9, 10, 11, 12, 20)], "k string, d date, c double")
    asked = spark.createDataFrame([("a", 1, day(0)), ("a", 2, day(2)), ("a", 3, day(12)), ("a", 4, day(9)), ("b", 5, day(0))], "k string, e int, at date")
    got = {r["e"]: (r["base_day"], r["end_day"], r["label"]) for r in events.event_study(asked, prices, "k", "e", "at", "d", "c").collect()}
    assert got == {1: (day(1), day(11), "positive"), 2: (day(8), day(20), "positive")}
    labels = spark.createDataFrame([("positive",), (None,), ("neutral",)], "label string")
    assert {r["label"]: r["n"] for r in events.label_counts(labels, "label").collect()} == {"positive": 1, "unlabelled": 1, "neutral": 1, "total": 3}
    assert {r["population"]: r["share"] for r in events.purity(labels, "label", F.lit(False)).collect()} == {"all": 0.3333}


def test_earnings(spark):
    fields = "corp string, year int, groups array<string>, revenue double, operating_income double, operating_cashflow double, net_income double, receivable double, total_liabilities double, total_equity double, total_assets double"
    g = ["X", "MARKET"]
    rows = [("a", y, g, 100.0 * 1.1**i, 10.0, 6.0, 5.0, 10.0, 50.0, 100.0 + i, 150.0 + i) for i, y in enumerate((2020, 2021, 2022))] + [("b", 2022, g, 10.0, None, 1.0, 1.0, 1.0, 5.0, -1.0, 4.0)]
    panel = spark.createDataFrame(rows, fields)
    m = {r["corp"]: r for r in earnings.firm_metrics(panel).collect()}
    assert m["a"]["cash_ratio"] == pytest.approx(0.6) and m["a"]["equity_growth"] == pytest.approx(1.02**0.5 - 1) and m["b"]["cash_ratio"] is None and m["b"]["leverage"] is None
    margins = [10 / (100 * 1.1**i) for i in range(3)]
    assert m["a"]["margin"] == pytest.approx(sum(x * (i + 1) for i, x in enumerate(margins)) / 6)
    s = {r["corp"]: r for r in earnings.quality_scores(panel, earnings.calibrated(panel)).collect()}
    assert s["a"]["m1"] == 33.3 and s["a"]["m2"] is None and s["b"]["m3"] == 0 and s["b"]["total"] == 0 and s["b"]["grade"] == "F" and s["a"]["excluded"] == "m2,m3,m4,m5"
    few = [(f"c{i}", y, g, 100.0 + i, 5.0 + i % 7, 4.0, 3.0, 10.0, 40.0 + i, 90.0, 130.0 + i) for i in range(25) for y in (2020, 2021, 2022)]
    more = panel.union(spark.createDataFrame(few, fields))
    found = {(r["group"], r["metric"]): r["n"] for r in earnings.calibrated(more).collect()}
    assert found["MARKET", "margin"] == 26 and found["X", "leverage"] == 26
    assert {r["corp"]: r["highlights"] for r in earnings.highlights(panel).collect()} == {"a": "strong_cash", "b": "negative_equity,leverage"}
    paid = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 110.0), ("a", 3, 80.0), ("b", 1, 0.0), ("c", 1, 5.0), ("d", 0, 900.0), ("d", 1, 0.0), ("d", 2, 10.0), ("d", 3, 10.2), ("e", 1, 1.0), ("e", 2, 1.0)], "k string, y int, d double")
    assert {r["k"]: r["continuity"] for r in earnings.dividend_score(paid, "k", "y", "d").collect()} == {"a": 62.5, "b": 0, "c": 45, "d": 67.5, "e": 70}


def test_relations(spark):
    raw = spark.createDataFrame([("a", "preferred", 90.0, 1), ("a", "common", 10.0, 2), ("b", "common", 5.0, 1), ("b", "common", None, 2), ("c", "odd", 1.0, 1), ("c", "odd", 1.0, 2)], "k string, kind string, r double, i int")
    assert {r["k"]: (r["r"], r["i"]) for r in relations.reduced(raw, ["k"], "kind", "r", "i").collect()} == {"a": (10.0, 2), "b": (5.0, 1), "c": (1.0, 2)}
    members = spark.createDataFrame([("g", "x", 1.0), ("g", "y", 2.0), ("g", "z", None), (None, "w", 9.0)], "g string, n string, cap double")
    assert sorted(tuple(r) for r in relations.stars(members, "g", "n", "cap").collect()) == [("g", "y", "x"), ("g", "y", "z")]
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "a", 3.0), ("c", "a", 2.0)], "s string, d string, v double")
    ego = {r["node"]: [(n["other"], n["direction"]) for n in r["neighbours"]] for r in relations.ego_documents(edges, "s", "d", "v").collect()}
    assert ego == {"a": [("a", "out"), ("c", "in"), ("b", "out")], "b": [("a", "in")], "c": [("a", "out")]}
    assert sorted(tuple(r) for r in relations.with_incoming(edges, "s", "d").collect()) == [("a", "a", False), ("a", "b", False), ("a", "c", True), ("b", "a", True), ("c", "a", False)]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "One. Two 2! Three? Four. Five. Six. Seven. Eight 8. Nine."), (2, None), (3, ""), (4, "no digit"), (5, "a\n\n\nb 1")], "i int, t string")
    split = {r["i"]: r["s"] for r in docs.select("i", chunks.sentences("t").alias("s")).collect()}
    assert split[1][:2] == ["One. ", "Two 2! "] and split[2] == [] and "".join(split[5]) == "a\n\n\nb 1" and len(split[5]) == 2
    got = [(r["i"], r["window"], r["part"], r["text"]) for r in chunks.candidate_chunks(docs, "i", "t", "[0-9]", around=1, most=20).collect()]
    assert got == [(1, 0, 0, "One. Two 2! Three? "), (1, 1, 0, "Seven. Eight 8. "), (1, 1, 1, "Nine."), (5, 0, 0, "a\n\n\nb 1")]


def test_statements(spark):
    items = spark.createDataFrame([("f", "k", "a", 1, 2020, 1.0), ("f", "k", "b", 2, 2020, 5.0), ("f", "k", "b", 2, 2021, 6.0)], "f string, k string, a string, r int, y int, v double")
    assert [tuple(r) for r in statements.complete_series(items, "f", "k", "a", "r", "y", "v", (2020, 2021)).collect()] == [("f", "k", "b", [5.0, 6.0])]
    assert statements.largest_by_name(spark.createDataFrame([("n", -9.0), ("n", 3.0)], "n string, v double"), ["n"], "v").first()["v"] == -9
    assert one(spark, a=statements.regime(F.lit(1), F.lit(-1), F.lit(-1)), b=statements.regime(F.lit(1), F.lit(0), F.lit(1)), c=statements.regime(F.lit(1), F.lit(None).cast("int"), F.lit(1))) == {"a": "mature", "b": "flat", "c": None}


HTML = "<p>(단위: 백만원)</p><table><tr><th>구분</th><th>가나</th><th>다라</th></tr><tr><td>매출</td><td>1,000</td><td>(20)</td></tr><tr><td>매입</td><td>-</td><td>5</td></tr></table>"
ROWS = "| 회사 | 매출 | 매입 |\n|---|---|---|\n| 마바 | 10 | 20 |\n|  | 30 | - |"


def test_tables(spark):
    docs = spark.createDataFrame([(1, HTML), (2, ROWS), (3, None), (4, "no table"), (5, "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr></table>")], "i int, t string")
    cells = tables.table_cells(docs, "i", "t")
    assert sorted((r["row"], r["col"], r["text"]) for r in cells.where("i = 5").collect()) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "b"), (1, 0, "a"), (1, 1, "c"), (1, 2, "d")]
    deals = sorted((r["i"], r["company"], r["deal"], r["amount"]) for r in tables.dealings(cells, "i").collect())
    assert deals == [(1, "가나", "customer", 1000.0), (1, "다라", "customer", -20.0), (1, "다라", "supply", 5.0), (2, "마바", "customer", 10.0), (2, "마바", "supply", 20.0)]
    items = tables.statement_items(docs, "i", "t", (("매출", "revenue"),))
    assert sorted((r["i"], r["column"], r["amount"]) for r in items.collect()) == [(1, 0, 1e9), (1, 1, -2e7)]
    assert [tuple(r) for r in tables.best_table(cells, "i", ["매출", "매입"]).collect()] == [(1, 0)]
    parts = tables.sections(spark.createDataFrame([(1, "intro\n1. A\nxx\n2. B\nyy zz"), (2, None)], "i int, t string"), "i", "t", r"[0-9]+\. ")
    assert [(r["place"], r["title"], r["body"]) for r in parts.orderBy("place").collect()] == [(0, None, "intro\n"), (1, "1. A", "xx\n"), (2, "2. B", "yy zz")]
    assert tables.capped_sections(parts, "i", 3, 7).first()["text"] == "int\nxx\n\ny"
    facts = spark.createDataFrame([(1, "yy\nzz"), (1, "no"), (9, "x")], "i int, q string")
    held = tables.quotes_held(facts, spark.createDataFrame([(1, "xx yy zz")], "i int, t string"), "i", "q", "t")
    assert sorted((r["i"], r["held"]) for r in held.collect()) == [(1, False), (1, True), (9, False)]


def test_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a,b\n# remark\ny, x\nx,y\nz,\n")
    assert [tuple(r) for r in files.blocked_pairs(spark, str(tmp_path / "b.csv")).collect()] == [("x", "y")]
    (tmp_path / "p.json").write_text(json.dumps({"panels": [{"corp_code": "1", "corp_name": "n", "industry_code": "26", "years": [{"year": 2020, "revenue": 1.5}, {"year": 2021}]}]}))
    assert [(r["corp_code"], r["year"], r["revenue"]) for r in files.panels(spark, str(tmp_path / "p.json"), "year: int, revenue: double").collect()] == [("1", 2020, 1.5), ("1", 2021, None)]
    (tmp_path / "c.xml").write_text("<result><list><corp_code>1</corp_code><corp_name>n</corp_name><stock_code> 005930 </stock_code></list><list><corp_code>2</corp_code><stock_code> </stock_code></list></result>")
    assert [r["stock_code"] for r in files.code_list(spark, str(tmp_path / "c.xml")).collect()] == ["005930"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a").write_bytes("가나".encode())
    (tmp_path / "raw/b").write_bytes("다라".encode("cp949"))
    assert sorted(r["text"] for r in files.decoded(spark, str(tmp_path / "raw")).collect()) == ["가나", "다라"]
    spans = one(spark, w=files.date_windows(F.lit("2024-01-01").cast("date"), F.lit("2024-01-08").cast("date"), 5))["w"]
    assert [(s["start"].day, s["end"].day) for s in spans] == [(1, 5), (6, 8)]
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "p string, v int")
    files.write_partitions(rows, str(tmp_path / "out"), "p")
    files.write_partitions(rows.where("p = 'x'").withColumn("v", F.lit(9)), str(tmp_path / "out"), "p")
    assert sorted((r["p"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("x", 9), ("y", 2)]


def test_streams(spark, tmp_path):
    moment = lambda s: dt.datetime(2024, 1, 1, 9, 0, 0) + dt.timedelta(seconds=s)
    schema = "k string, i int, ts timestamp"
    for n, rows in enumerate([[("a", 1, moment(0)), ("a", 2, moment(1))], [("a", 2, moment(1)), ("b", 3, moment(2))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    for n in range(2):  # a second run adds nothing
        ledger.keep(feeds.polled_once(stream, "i", "ts").withColumn("day", F.to_date("ts")), str(tmp_path / "table"), str(tmp_path / f"state{n}"), ["i"], "day").awaitTermination()
    assert sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 2, 3]
    spark.createDataFrame([("k", j, moment(s)) for j, s in enumerate((0, 1, 2, 30, 61, 62))], schema).coalesce(1).write.parquet(str(tmp_path / "asked"))
    asked = feeds.event_stream(spark, str(tmp_path / "asked"), spark.createDataFrame([], schema).schema)
    q = feeds.admitted(asked, "k", "ts", most=2).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "s3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["ok"] for r in spark.sql("SELECT * FROM admitted ORDER BY ts").collect()] == [True, True, False, False, True, True]
    assert feeds.polled_once(spark.read.parquet(str(tmp_path / "in")), "i", "ts").count() == 3
