"""From raw relations to edges: guards of linking, the order of rows, second runs, and what is pruned."""

import random

import pytest

from finloom.operators import relations as R
from finloom.operators import silver as V

RAW = "id long, source_type string, source_name string, target_name string, relate string, ratio double, stock_kind string, year int, raw_response string"
REGISTRY = [("SK이노베이션", "096770"), ("SK하이닉스", "000660"), ("㈜해성산업", "034810"), ("계양전기", "012200"), ("HMM", "011200"), ("현대차", "005380"), (None, "1"), ("x", None)]


@pytest.fixture(scope="module")
def run(spark):
    registry = spark.createDataFrame(REGISTRY, "name string, code string")
    blocked = spark.createDataFrame([("005380", "011200")], "source string, target string")
    overrides = spark.createDataFrame([("000660", "SK")], "code string, group_name string")

    def of(rows):
        return V.judged(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RAW).repartition(2), registry, blocked, overrides)

    return of


def holder(name, firm="계양전기", relate=None, ratio=10.0, stock=None, year=2024):
    return (V.HOLDERS, name, firm, relate, ratio, stock, year, None)


def invested(firm, name, ratio=10.0, year=2024):
    return (V.INVESTED, firm, name, None, ratio, None, year, None)


def fates(df):
    return [r["fate"] for r in df.orderBy("id").collect()]


def test_guards(run):
    rows = run([
        invested("현대차", "HMA"), invested("현대차", "HMM"), invested("현대차", "SK하이닉스 주식회사", 100.0), invested("현대차", "SK하이닉스", 710651.0), invested("현대차(주)", "㈜현대차"), invested("없는회사", "HMM"),
        invested("현대차", "합계"), holder("보통주"), holder(" 우선주 "), holder("계양전기"), holder("㈜해성산업", ratio=34.0), holder("홍길동", relate="본인"), holder("합계"), holder("x", "없는회사"),
        (V.GROUPS, "096770", "000660", None, None, None, 2024, '{"group_name": "raw"}'), (V.GROUPS, "000660", "096770", None, None, None, 2024, '{"group_name": "raw"}'), (V.GROUPS, "SK하이닉스", "096770", None, None, None, 2024, None),
        (V.FILINGS, "096770", "000660", "기타", None, None, 2024, None), (V.FILINGS, "096770", "x", None, None, None, 2024, None), ("news", "096770", "000660", None, None, None, 2024, None), (V.HOLDERS, None, None, None, None, None, None, None),
    ])
    assert fates(rows) == [
        "kept_ownership", "blocklist", "kept_ownership", "ratio_invalid", "own", "unmatched", "unmatched", "stock_kind_row", "stock_kind_row", "self_loop", "kept_ownership", "kept_ownership", "unmatched", "unmatched",
        "kept_ftc", "kept_ftc", "unmatched", "kept_filing", "ignored", "ignored", "unmatched",
    ]
    got = {r["id"]: r for r in rows.collect()}
    assert got[0]["target"].startswith("x_") and got[0]["queued"] and not got[1]["queued"] and got[2]["target"] == "000660"
    assert (got[10]["source"], got[10]["target"]) == ("034810", "012200") and (got[14]["group_name"], got[15]["group_name"]) == ("SK", "raw")
    nodes = {r["name"]: (r["anchor"], r["kind"], r["first_seen"]) for r in V.silver_nodes(rows).collect()}
    assert nodes == {"HMA": ("005380", "private_corp", f"{V.INVESTED}:2024"), "홍길동": ("012200", "person", f"{V.HOLDERS}:2024")}


def test_stock_kinds_in_any_order(run):
    rows = [
        holder("㈜해성산업", ratio=0.71, stock="우선주"), holder("㈜해성산업", ratio=34.0, stock="보통주"), holder("㈜해성산업", ratio=50.0, stock=None), holder("HMM", ratio=29.91, stock="우선주"), holder("HMM", ratio=7.55, stock="보통주"),
        holder("현대차", ratio=None), holder("현대차", ratio=3.0), holder("현대차", ratio=2.0),
    ]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert {r["source"]: r["ratio"] for r in V.silver_edges(run(rows)).collect()} == {"034810": 34.0, "011200": 7.55, "005380": 3.0}


def test_nodes_settle_whatever_the_order(run):
    rows = [holder("윤 정", relate="임원"), holder("윤정 (주1)", relate="-"), holder("윤정(보통주)", relate="기타", year=2023), holder("하이원파트너스\n(비상장)"), holder("㈜하이원파트너스"), invested("계양전기", "오뚜기")]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        seen.add(tuple(sorted((r["uid"], r["anchor"], r["kind"], r["relate"] == "임원") for r in V.silver_nodes(run(rows)).collect())))
    assert len(seen) == 1 and sorted(k for _, _, k, _ in seen.pop()) == ["person", "private_corp", "private_corp"]


def test_counters_and_second_run(spark, run):
    rows = run([invested("현대차", "HMA"), invested("현대차", "HMM"), invested("현대차", "SK하이닉스", 710651.0), holder("계양전기"), holder("보통주"), holder("홍길동", relate="본인"), (V.GROUPS, "096770", "000660", None, None, None, 2024, None)])
    edges, nodes = V.silver_edges(rows), V.silver_nodes(rows)
    one = spark.createDataFrame([("a", "b", V.GROUPS, 2020), ("096770", "000660", V.FILINGS, 2019), ("x_gone", "000660", V.FILINGS, 2019)], "source string, target string, source_type string, year int")
    old_nodes = spark.createDataFrame([("x_1", "096770", "Ltd.가나(*1)", "private_corp", None, "note"), ("x_2", "096770", "가나", "private_corp", None, "note"), ("x_3", "096770", "합계", "private_corp", None, "note"), ("x_4", "000660", "조달청", "person", None, "note")], "uid string, anchor string, name string, kind string, relate string, first_seen string")
    got = V.counters(rows, one, old_nodes).first().asDict()
    want = dict.fromkeys([*V.FATES.values(), "dropped_personal", "dropped_foundation"], 0) | {"kept_ownership": 2, "kept_ftc": 1, "dropped_blocklist": 1, "dropped_ratio_invalid": 1, "dropped_self_loop": 1, "dropped_stock_kind_row": 1, "queued_ambiguous": 1, "unlisted_nodes": 2}
    assert got == want | {"pruned_stale": 1, "pruned_orphan_nodes": 3, "kind_reconciled": 4} and len(got) == 15
    again = V.counters(rows, edges.select(*V.KEY), nodes).first().asDict()
    assert (again["pruned_stale"], again["pruned_orphan_nodes"], again["kind_reconciled"]) == (0, 0, 0)
    watched, seen = V.observed(rows)
    assert watched.where("fate LIKE 'kept%'").count() == 3
    assert {k: v for k, v in got.items() if k in seen.get} == seen.get and seen.get["dropped_self_loop"] == 1
    kept, moves = V.reconciled(old_nodes)
    assert sorted((r["uid"], r["name"], r["kind"]) for r in kept.collect()) == [("x_1", "가나", "private_corp"), ("x_4", "조달청", "public_org")]
    assert sorted(((r["old"], r["new"]) for r in moves.collect()), key=str) == [("x_2", "x_1"), ("x_3", None)]
    assert V.referenced(nodes, edges).count() == 2 and V.counters(rows.where("false"), one.where("false"), old_nodes.where("false")).first()["kept_ftc"] == 0


def test_names_by_ear_never_overwrite(spark):
    firms = spark.createDataFrame([("CJ제일", "1"), ("씨제이제일", "2"), ("LG전자", "3"), ("SK", "4"), ("KT", "5"), ("㈜KT", "6"), ("Kt", "7"), ("A가", "8"), ("에이가", None), ("AB나", "10"), ("A비나", "11"), (None, "12")], "n string, c string")
    book = {r["name"]: (r["code"], r["spoken"]) for r in R.name_book(firms, "n", "c").collect()}
    assert book["씨제이제일"] == ("2", False) and book["엘지전자"] == ("3", True) and book["kt"] == ("7", False)  # of one name the last code
    assert "케이티" not in book and book["에이가"] == ("8", True)  # called alike by several firms; a firm without a code isn't one
    assert "에이비나" not in book
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(["씨제이제일(주)", "엘지 전자", "SK", "KT", "HMA", "없음", "", None])], "i int, n string")
    got = [(r["code"], r["queued"]) for r in R.resolved(asked, "n", R.name_book(firms, "n", "c")).orderBy("i").collect()]
    assert got == [("2", False), ("3", False), ("4", False), ("7", False), (None, True), (None, True), (None, False), (None, False)]


def test_names_are_read_once(spark):
    """Rows of one pair of names: what they are called is told for each name, not for each row, and rows meet it in one join
    for each end, blocked pairs and groups of others included."""
    raw = spark.range(1000).selectExpr("id", f"'{V.HOLDERS}' AS source_type", "'Sup1 Co., Ltd.' AS source_name", "'Firm1' AS target_name", "'-' AS relate", "1.0 AS ratio", "'보통주' AS stock_kind", "cast(2000 + id AS int) AS year", "'{}' AS raw_response")
    listed = spark.createDataFrame([("Firm1", "C1"), ("Sup1", "S1")], "name string, code string")
    none = "a string, b string"
    ends = V.named_ends(raw.selectExpr("'n:' || source_name AS _key"), listed, spark.createDataFrame([("S1", "C2")], none).toDF("source", "target"), spark.createDataFrame([("S1", "g")], none).toDF("code", "group_name"))
    assert [(r["code"], r["own"], r["against"]) for r in ends.collect()] == [("S1", "g", ["C2"])]
    rows = V.judged(raw, listed, spark.createDataFrame([], none).toDF("source", "target"), spark.createDataFrame([], none).toDF("code", "group_name"))
    assert {(r["source"], r["target"], r["fate"]) for r in rows.collect()} == {("S1", "C1", "kept_ownership")}
