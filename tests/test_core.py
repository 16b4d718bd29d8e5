"""Core accounts of statements: names, amounts, guards against look-alikes, units by block, and columns by their heads."""

import pytest
from pyspark.sql import functions as F

from finloom.operators import core as C


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_names_and_amounts(spark):
    names = {"Ⅰ. 매출액": "매출액", "매출액(주6,32)": "매출액", "매출원가 (주석 30)": "매출원가", "수익(매출액)": "수익(매출액)", "-당기순이익(손실)": "당기순이익(손실)", "Ⅰ.1. 자산<P>총계</P>": "자산총계", "영업이익<주13>": "영업이익", "(1) 매출": "매출", "": "", None: ""}
    assert one(spark, names, C.account_label) == [*names.values()]
    amounts = {"1,234": 1234.0, "(1,234)": -1234.0, "△1,234": -1234.0, "▲ 5": -5.0, "-7": -7.0, "-": None, "": None, " ": None, "N/A": None, "1.5": 1.5, "( △3 )": -3.0, "가": None, None: None, "&nbsp;9": 9.0}
    assert one(spark, amounts, C.filed_amount) == [*amounts.values()]


def rows_of(spark, rows):
    schema = "k long, kind string, statement string, code string, name string, amount double, place int, unit double, order int, y int"
    return spark.createDataFrame([(1, kind, s, code, name, amount, place, 1.0, i, 2025) for i, (kind, s, code, name, amount, place) in enumerate(rows)], schema)


@pytest.mark.parametrize("rows, want", [
    ([("CFS", "IS", "x", "이자수익", 5.0, 0), ("CFS", "IS", "ifrs-full_Revenue", "영업수익", 7.0, 0)], {"revenue": (7.0, 1)}),
    ([("CFS", "IS", "", "매출액", 1.0, 0), ("CFS", "IS", "ifrs-full_Revenue", "수익", 9.0, 0)], {"revenue": (9.0, 1)}),
    ([("CFS", "IS", "ifrs-full_Revenue", "이자수익", 5.0, 0)], {}),
    ([("CFS", "IS", "ifrs-full_Revenue", "합계", 5.0, 0), ("CFS", "CIS", "", "매출(영업수익)", 6.0, 0)], {"revenue": (6.0, 3)}),
    ([("CFS", "CF", "ifrs-full_CashFlowsFromUsedInInvestingActivities", "투자활동으로인한현금유입액", 2.0, 0), ("CFS", "CF", "-", "투자활동현금흐름", -3.0, 0)], {"investing_cashflow": (-3.0, 2)}),
    ([("CFS", "SCE", "ifrs-full_Equity", "자본총계", 1.0, 0), ("CFS", "BS", "ifrs-full_Equity", "자본총계", 2.0, 0)], {"total_equity": (2.0, 1)}),
    ([("CFS", "CF", "ifrs-full_ProfitLoss", "당기순이익", 1.0, 0)], {}),
    ([("CFS", "IS", "", "매출원가", -70.0, 0)], {"cogs": (70.0, 2)}),
    ([("CFS", "IS", "ifrs-full_Revenue", "영업수익", 0.0, 0)], {}),
    ([("CFS", "IS", "ifrs-full_Revenue", "영업수익", 0.0, 0), ("CFS", "CIS", "ifrs-full_Revenue", "매출액", 4.0, 0)], {"revenue": (4.0, 1)}),
])
def test_guards(spark, rows, want):
    got = C.core_accounts(rows_of(spark, rows), "k").collect()
    assert {r["account"]: (r["amount"], r["rank"]) for r in got} == want


def test_columns_are_years(spark):
    got = C.core_accounts(rows_of(spark, [("OFS", "BS", "", "자산총계", float(p), p) for p in range(3)]), "k", "y").collect()
    assert {r["place"]: (r["fiscal_year"], r["amount"], r["kind"]) for r in got} == {0: (2025, 0.0, "OFS"), 1: (2024, 1.0, "OFS"), 2: (2023, 2.0, "OFS")}


def test_filings(spark):
    row = lambda *cells: "<TR>" + "".join(f"<TD>{c}</TD>" for c in cells) + "</TR>"
    titled = (
        "<TITLE>2-1. 연결 재무상태표(대차대조표)</TITLE><P>(단위 : 백만원)</P><TABLE>" + row("과목", "주석", "제 31 기", "제 30 기", "제 29 기") + row("자산총계", "22", "1,000", "900", "-") + row("부채총계", "1") + "</TABLE>"
        "<TITLE>기타</TITLE>" + row("자본총계", "1") + "<TITLE ATOC='Y'>4-2. 포괄손익계산서</TITLE>(단위: 천원)" + row("매출액", "5", "(4)") + '<TR><TE>x</TE><TE ACODE="ifrs-full_ProfitLoss">7</TE></TR>' + "<TITLE>주석</TITLE>"
    )
    grouped = '<TABLE-GROUP ACLASS="{XBRL}BS2">' + row("연 결 재 무 상 태 표") + row("단위: 원", "") + row("자산", "3") + "</TABLE-GROUP>" + row("부채총계", "9") + '<TABLE-GROUP ACLASS="{XBRL}IS2">' + row("손익계산서") + row("매출", "8") + "</TABLE-GROUP>"
    df = spark.createDataFrame([(1, titled), (2, grouped), (3, "no statements"), (4, None), (5, "")], "k long, t string").repartition(2)
    got = C.core_accounts(C.statement_rows(C.statement_blocks(df, "k", "t"), "k"), "k").collect()
    assert sorted((r["k"], r["kind"], r["account"], r["place"], r["amount"]) for r in got) == [
        (1, "CFS", "total_assets", 0, 1e9), (1, "CFS", "total_assets", 1, 9e8), (1, "OFS", "net_income", 0, 7e3), (1, "OFS", "revenue", 0, 5e3), (1, "OFS", "revenue", 1, -4e3),
        (2, "CFS", "total_assets", 0, 3.0), (2, "OFS", "revenue", 0, 8.0),
    ]


def test_blocks_of_texts_dealt_out_before(spark, tmp_path):
    """A filing has titled statements or groups of tables, not both, though its text is dealt out by key already."""
    table = "<TR><TD>손익계산서</TD></TR><TR><TD>매출액</TD><TD>8</TD></TR>"
    group, title = f'<TABLE-GROUP ACLASS="{{XBRL}}IS2">{table}</TABLE-GROUP>', f"<TITLE>4-2. 연결 손익계산서</TITLE>{table}"
    rows = [(k, [group + title, group, title, "no statements"][k % 4]) for k in range(40)] + [(None, group + title), (99, None)]
    spark.createDataFrame(rows, "k long, t string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts").repartition("k")
    found = sorted((r["k"], r["kind"]) for r in C.statement_blocks(df, "k", "t").collect())
    assert found == [(k, ["CFS", "OFS", "CFS"][k % 4]) for k in range(40) if k % 4 < 3]
