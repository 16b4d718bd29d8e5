"""Small cases of parties and upkeep: nulls, empty tables, repeated rows and names that say two things."""

import random

from pyspark.sql import functions as F

from finloom.functions import parties as P
from finloom.operators import relations
from finloom.operators import upkeep as U
from finloom.plans.tables import edges
from finloom.plans.upkeep import absent_relations


def test_no_party(spark):
    cases = {None: "empty_or_total", " - ": "empty_or_total", "N/A": "empty_or_total", "LTD": "suffix_fragment", "23.99%": "numeric_only", "2)": "numeric_only", "*) 한빛": "footnote_prefix", "자기 주식": "aggregate_token", "한빛 매출": "txn_item", "한빛매출 Ltd": None, "한빛": None, "우리산업(주)와 그 종속기업": None}
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(cases)], "i int, n string").select("i", P.no_party("n").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [*cases.values()]


def test_party_kind(spark):
    cases = {
        ("홍길동", "본     인"): "person", ("롯데물산", "모회사"): "private_corp", ("홍길동", "지배회사의 등기임원"): "person", ("성우물산", "임원이 지배하는 법인"): "private_corp", ("홍길동", "특수관계인\n(계열회사 임원)"): "person",
        ("(주)한빛 110111-4686139", None): "private_corp", ("법인등록번호 110111-4686139", None): "private_corp", ("오뚜기", None): "private_corp", ("조달청", None): "public_org", (None, None): "private_corp", ("한빛 사모 펀드", "자"): "coop_fund",
    }
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n string, r string").select("i", P.party_kind("n", "r").alias("v"), P.party_kind("n", "r", may_be_person=False).alias("w"), P.party_kind("n", "r", by_family_name=True).alias("x")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [*cases.values()]
    assert not any(r["w"] == "person" for r in rows) and rows[7]["x"] == "person"


def test_absent_from_notes(spark):
    edges = spark.createDataFrame([("r", "a", 2020), ("r", "a", 2020), ("r", "b", 2020), ("r", "c", 2020), ("r", "d", 2020), ("r", "d", 2021), ("r", "e", None), ("s", "a", 2019), ("t", "a", 2019)], "reporter string, target string, year int")
    notes = spark.createDataFrame([("r", 2020, "BETA"), ("r", 2021, "xxALPHAxx"), ("r", 2021, None), ("r", None, "BETA"), ("s", 2020, None)], "reporter string, year int, text string")
    names = spark.createDataFrame([("a", "GAMMA"), ("a", "ALPHA"), ("b", "BETA"), ("c", ""), ("c", None), ("e", "EPSILON")], "target string, name string")
    got = {(r["reporter"], r["target"], r["year"]): r["verdict"] for r in U.absent_from_notes(edges, notes, names).collect()}
    assert got == {("r", "a", 2020): "kept", ("r", "b", 2020): "terminated", ("r", "c", 2020): "undecidable", ("r", "d", 2020): None, ("r", "d", 2021): None, ("r", "e", None): "terminated", ("s", "a", 2019): None, ("t", "a", 2019): None}
    assert U.absent_from_notes(edges, notes, names).count() == 9 and U.absent_from_notes(edges.where("false"), notes, names).count() == 0


def test_absent_from_notes_by_brute_force(spark):
    """Several texts and names, repeated rows and nulls on all sides: each edge stays one row, with the verdict of the rule."""
    rng = random.Random(3)
    edges = [(rng.choice(["r", "s", "t", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([2019, 2020, 2021, None]), i) for i in range(120)]
    notes = [(rng.choice(["r", "s", None]), rng.choice([2019, 2020, None]), rng.choice(["xAx", "By", "CC", "", None])) for _ in range(12)] + [("r", 2021, "xAx"), ("r", 2021, "zCz"), ("s", 2021, "AB"), ("t", 2022, None), ("t", 2021, "A")]
    names = [("a", "A"), ("a", "A"), ("a", "Q"), ("b", "Q"), ("b", "C"), ("c", "Q"), ("c", ""), ("d", None), (None, "A")]
    want = {}
    for r, t, _, i in edges:
        newest = max((y or 0 for n, y, _ in notes if n == r), default=None)
        texts = [x for n, y, x in notes if n == r and (y or 0) == newest and x]
        known = {n for k, n in names if k == t and n}
        old = texts and max(y or 0 for a, b, y, _ in edges if (a, b) == (r, t)) < newest
        want[i] = None if None in (r, t) or not old else "undecidable" if not known else "kept" if any(n in x for n in known for x in texts) else "terminated"
    got = U.absent_from_notes(spark.createDataFrame(edges, "reporter string, target string, year int, i int"), spark.createDataFrame(notes, "reporter string, year int, text string"), spark.createDataFrame(names, "target string, name string"))
    assert got.columns == ["reporter", "target", "year", "i", "verdict"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[3] for r in rows) == [*range(120)] and {r[3]: r[4] for r in rows} == want and {r[3]: r[:3] for r in rows} == {e[3]: e[:3] for e in edges}


def test_absent_relations_reads_lines_once(spark):
    """Edges and notes share one shuffle of what lines and orders give, so that the two are read and joined once."""
    found = absent_relations(spark, "/root/testdata/sf0.001")
    assert found.count() == len(found.collect()) > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [l_orderkey") == 1


def test_repointed(spark):
    edges = spark.createDataFrame([("a", "b", 1, "x"), ("a", "c", 1, "y"), ("b", "c", 2, "z"), ("d", "d", 3, "w"), (None, "c", 4, "n")], "a string, b string, y int, v string")
    moves = spark.createDataFrame([("c", "b"), ("d", "d"), ("q", None)], "old string, new string")
    got = sorted(((r["a"], r["b"], r["y"], r["v"]) for r in U.repointed(edges, moves, "a", "b", ["y"]).collect()), key=str)
    assert got == sorted([("a", "b", 1, "x"), ("d", "d", 3, "w"), (None, "b", 4, "n")], key=str)


def test_stale_and_basis(spark):
    rows = spark.createDataFrame([("m", 1), ("m", 2), ("o", 2), (None, 2)], "s string, k int")
    left = U.without_stale(rows, spark.createDataFrame([(1,), (1,)], "k int"), "s", ["m"], ["k"]).collect()
    assert sorted(map(str, ((r["s"], r["k"]) for r in left))) == sorted(map(str, [("m", 1), ("o", 2), (None, 2)]))
    items = spark.createDataFrame([(1, "계속영업기본주당이익", 3.0), (1, "중단영업 기본주당이익", 1.0), (2, "계속영업 기본주당이익", 3.0), (2, "중단영업기본주당이익", 0.0), (3, None, None)], "f int, n string, a double")
    assert sorted((r["f"], r["a"]) for r in U.one_basis(items, ["f"], "n", "a").where("f < 3").collect()) == [(1, 1.0), (2, 0.0), (2, 3.0)]
    assert U.one_basis(items, ["f"], "n", "a").count() == 4
    arrays = spark.range(1).select(*(F.array(*map(F.lit, v)).cast("array<double>").alias(k) for k, v in {"x": [1.0, 2.0], "y": [0.5, None], "z": [1.0]}.items()))
    got = arrays.select(U.derived_series(F.col("x"), F.col("x"), -1).alias("a"), U.derived_series(F.col("x"), F.col("y"), 1).alias("b"), U.derived_series(F.col("x"), F.col("z"), 1).alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == ([0.0, 0.0], None, None)


def test_edges_join_lines_once(spark):
    """Shares come of one join of lines and orders; where none is asked for, edges aren't summed by customer."""
    found = edges(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(found).count("Join ") == 1
    assert "Window" not in plan(found.select("src", "dst", "year"))
    ego = plan(relations.ego_documents(found, "src", "dst", "share"))
    assert ego.count("max(share") == 2  # both branches have the same ends, which are shuffled once
