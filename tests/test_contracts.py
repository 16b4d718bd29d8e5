"""Forms of contracts: labels anywhere in a row, amounts by order of labels, sides that are named, strange or absent."""

import datetime as dt

from pyspark.sql import functions as F

from finloom.operators import contracts as K
from finloom.operators import relations as R


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


FORMS = [
    "<table>" + row("1. 계약내용", "공급") + row("2. 계약내역", "확정 계약금액", "-") + row("계약금액 총액(원)", "1,000") + row("3. 계약상대방", " 스튜디오에스 <b>주식회사</b> ") + row("5. 계약기간", "시작일", "2026-01-01") + row("종료일", "2026-12-31까지") + row("계약(수주)일자", "2026-02-03") + "</table>",
    row("확정 계약금액", "4,746,484,750") + row("계약금액 총액", "-") + row("계약상대방", "방산 솔루션 공급 업체"),
    row("계약금액 총액", "0") + row("계약상대방", "-") + row("계약상대방", "둘째") + row("값만"),
    row("값", "계약상대방"), "", None,
]


def test_forms(spark):
    df = spark.createDataFrame([*enumerate(FORMS)], "k long, t string").withColumn("r", F.lit(dt.date(2025, 5, 5)))
    got = {r["k"]: (r["counterparty"], r["amount"], r["year"], r["valid_until"]) for r in K.contract_forms(df, "k", "t", F.col("r")).collect()}
    assert got == {
        0: ("스튜디오에스 주식회사", 1000.0, 2026, "2026-12-31"), 1: ("방산 솔루션 공급 업체", 4_746_484_750.0, 2025, None), 2: ("-", None, 2025, None),
        3: (None, None, 2025, None), 4: (None, None, 2025, None), 5: (None, None, 2025, None),
    }
    titles = spark.createDataFrame([(i, t) for i, t in enumerate(["단일판매ㆍ공급계약체결", "[기재정정]단일판매ㆍ공급계약체결", "배당", None])], "i int, t string")
    assert [r["v"] for r in titles.select("i", K.is_contract(F.col("t")).alias("v")).orderBy("i").collect()] == [True, False, False, False]


def test_edges(spark):
    book = R.name_book(spark.createDataFrame([("스튜디오에스", "1"), ("그린광학", "2")], "n string, c string"), "n", "c")
    schema = "k long, counterparty string, amount double, year int, valid_until string, me string"
    forms = spark.createDataFrame([(1, "스튜디오에스 주식회사", 5.0, 2026, None, "2"), (1, "스튜디오에스 주식회사", 5.0, 2026, None, "2"), (2, "방산 업체", 1.0, 2026, None, "2"), (3, "", 1.0, 2026, None, "2"), (4, "㈜그린광학", 1.0, 2026, None, "2"), (5, None, None, None, None, None)], schema)
    got = sorted((r["k"], r["fate"], r["source"], r["target"]) for r in K.contract_edges(forms, book, "me", "k").collect())
    assert got == [(1, "kept", "2", "1"), (2, "link_failed", "2", None), (3, "no_counterparty", "2", None), (4, "own", "2", None), (5, "no_counterparty", None, None)]
