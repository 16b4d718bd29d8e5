"""Small functions that no query shows: sources, names, numbers and hours."""

import datetime as dt
import json

from pyspark.sql import functions as F

from finloom.functions import numbers as N
from finloom.functions import texts as X
from finloom.operators import deltas as D
from finloom.operators import financials as B
from finloom.operators import keyed as K
from finloom.operators import tables as T
from finloom.sources import files
from finloom.streaming import feeds


def test_sector_map(spark, tmp_path):
    (tmp_path / "map.csv").write_text("code,sector\n# a remark\n1, semi \n2,fin\n,none\n3,\n")
    (tmp_path / "own.csv").write_text("code,sector\n2,bio\n4,auto\n")
    of = lambda *paths: {r["code"]: r["sector"] for r in files.sector_map(spark, *(str(tmp_path / p) for p in paths)).collect()}
    assert of("map.csv") == {"1": "semi", "2": "fin", "3": None} and of("map.csv", "own.csv") == {"1": "semi", "2": "bio", "3": None, "4": "auto"}


def test_documents_and_audits(spark, tmp_path):
    files.write_documents(spark.createDataFrame([(1, ["a"]), (2, None)], "k int, v array<string>"), str(tmp_path / "out"))
    lines = [json.loads(line) for p in (tmp_path / "out").glob("part-*.json") for line in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["k"]) == [{"k": 1, "v": ["a"]}, {"k": 2}]
    rows = spark.createDataFrame([(1, '["a", " "]'), (2, "plain"), (3, " "), (4, None), (5, "[]")], "k int, v string")
    assert {r["k"]: r["v"] for r in files.audit_rows(rows, "v").collect()} == {1: ["a"], 2: ["plain"]}


def test_names_and_links(spark):
    rows = spark.createDataFrame([(0, "Ⅰ. 매출액(주석 3)"), (1, "1) 자산 <b>총계</b>*"), (2, None)], "i int, n string")
    assert [r["v"] for r in rows.select("i", X.account_name("n").alias("v")).orderBy("i").collect()] == ["매출액", "자산총계", None]
    link = spark.range(1).select(X.news_link("http://x/s", F.lit("가 나"), F.lit(dt.date(2024, 1, 2))).alias("v")).first()["v"]
    assert link.startswith("http://x/s?q=%EA%B0%80") and link.endswith("&from=2023-12-30&to=2024-01-05")


def test_amounts_alike(spark):
    array = lambda v: F.array(*map(F.lit, v)).cast("array<double>")
    got = spark.range(1).select(N.rounded_alike(array([1234.56, -0.4, None]), F.lit("억")).alias("a"), N.rounded_alike(array([12.345, 0.05]), F.lit("억")).alias("b"), N.rounded_alike(array([0.1234, -0.0001]), F.lit("조")).alias("c"), N.rounded_alike(array([2.345]), F.lit("조")).alias("d")).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == ([1235.0, 0.0, None], [12.3, round(0.05, 1)], [0.123, 0.0], [round(2.345, 2)])
    assert str(got["c"][1]) == "0.0"


def test_market_hours(spark):
    moments = {"2024-01-05 00:00:00": True, "2024-01-05 06:30:00": True, "2024-01-05 06:31:00": False, "2024-01-04 23:59:00": False, "2024-01-06 01:00:00": False}
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, m string").select("i", feeds.in_market_hours(F.col("m").cast("timestamp")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [*moments.values()]


def test_numbers_and_shares(spark):
    parts = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 2), ("c", 0), ("d", None)], "k string, n int")
    assert {r["k"]: (r["n"], r["most"], r["missing"]) for r in T.missing_numbers(parts, "k", "n").collect()} == {"a": (3, 4, [2, 3]), "b": (1, 2, [1])}
    docs = spark.createDataFrame([(1, "| 제품 | 비중 |\n|-|-|\n| 디램 | 60.5% |\n| 디램 | 2% |\n| 낸드 | (39.5%) |\n| 합계 | 100% |\n| 기타 | 많음 |"), (2, None)], "k int, t string")
    assert {r["product"]: round(r["share"], 6) for r in T.shares_of_products(docs, "k", "t").collect()} == {"디램": 0.605, "낸드": 0.395}


def test_filled(spark):
    index, rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1, None)], "k string, n int, t string")
    assert sorted((r["k"], r["n"], r["t"]) for r in K.filled(index, rows, ["k"], {"n": 0, "t": "-"}).collect()) == [("a", 1, "-"), ("b", 0, "-")]


def test_deltas(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", None), ("d", 2.0), ("e", 3.0), ("f", None)], "k string, s double")
    new = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 4.0), ("d", None), ("g", 7.0), ("f", None)], "k string, s double")
    rows = D.compared_scores(old, new, "k", "s")
    got = D.delta_summary(rows).first().asDict()
    assert got == {"common": 2, "new": 1, "gone": 1, "scored": 1, "lost": 1, "unscored": 1, "mean_delta": -1.5, "largest": 4.0, "median_delta": -1.5}
    assert [(r["k"], r["place"]) for r in D.largest_moves(rows, "k").orderBy("place").collect()] == [("b", 1), ("a", 2)]
    nothing = D.delta_summary(rows.where("false")).first()
    assert nothing["common"] == 0 and nothing["median_delta"] is None


def test_yields(spark):
    day = lambda y, m: dt.date(y, m, 1)
    paid = spark.createDataFrame([("a", day(2023, 3), 100.0), ("a", day(2023, 9), 50.0), ("b", day(2023, 3), 10.0), ("c", day(2022, 1), 5.0)], "k string, day date, amount double")
    closes = spark.createDataFrame([("a", day(2023, 1), 900.0), ("a", day(2023, 12), 1000.0), ("a", day(2023, 12), None), ("a", day(2024, 1), 500.0), ("b", day(2023, 5), 0.0)], "k string, day date, close double")
    got = {(r["k"], r["year"]): (r["dps"], r["dividend_yield"]) for r in B.yearly_yields(paid, closes, "k").collect()}
    assert got == {("a", 2023): (150.0, 0.15), ("a", 2024): (0.0, 0.0), ("b", 2023): (10.0, 0.0)}
