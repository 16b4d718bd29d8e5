"""Small cases of labels and summaries: nulls, empties, ties and what depends on itself."""

from pyspark.sql import functions as F

from finloom.functions import labels as L
from finloom.functions import numbers as N
from finloom.functions import texts as X
from finloom.operators import summaries as S
from finloom.operators.earnings import mean_of_available


def values(spark, f, cases):
    rows = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], "i int, a string, b string" if isinstance(next(iter(cases)), tuple) else "i int, a string")
    return [r["v"] for r in rows.select("i", f.alias("v")).orderBy("i").collect()]


def test_names(spark):
    spoken = {"CJ제일제당": "씨제이제일제당", "LG에너지솔루션": "엘지에너지솔루션", "SK하이닉스": "에스케이하이닉스", "Global": None, "한빛": None, "": None, None: None, "kt": "케이티"}
    assert values(spark, L.spoken_name("a"), [*spoken]) == [*spoken.values()]
    shown = {"Iksuda Therapeutics Limited(*3)": "Iksuda Therapeutics Limited", "(주)프로젠(보통주)": "(주)프로젠", "LTD.HWASEUNG VIETNAM CO.": "HWASEUNG VIETNAM CO.", "DB(Philippines) Inc.": "DB(Philippines) Inc.", "조합 *": "조합", None: "", " ": ""}
    assert values(spark, L.shown_name("a"), [*shown]) == [*shown.values()]


def test_particles(spark):
    way = {"서울": "서울로", "집": "집으로", "가": "가로", "3": "3으로", "7": "7로", "LG": "LG로", "(남)": "(남)으로", "": "로", None: None}
    assert values(spark, L.with_particle("a", "으로"), [*way]) == [*way.values()]
    assert values(spark, L.with_particle("a", "을를", boxed=True), ["12", "10%"]) == ["[12]를", "[10%]을"]


def test_parties(spark):
    classes = {"사업보고서 주석: 지배기업": "지배기업", "대규모기업집단(*1)": "대규모기업집단", "기  타": "기타", "최상위 지배기업": "최상위 지배기업", "임원": "임원", "(*3)": "", "": "", None: ""}
    assert values(spark, L.party_class("a"), [*classes]) == [*classes.values()]
    ways = {"대여거래,대여": "capital_out", "대여거래,회수": None, "차입": "capital_in", "대여,차입": None, "대여금": None, " , ": None, None: None}
    assert values(spark, L.capital_direction("a"), [*ways]) == [*ways.values()]
    persons = {("홍길동", None): True, ("홍길동", "계열회사"): False, ("홍길동", "친인척"): True, ("(주)한빛", None): False, ("x 900101-1234567", "법인"): True, ("한빛전자산업", None): False, (None, "본인"): False}
    assert values(spark, L.is_person("a", "b"), [*persons]) == [*persons.values()]


def test_words_of_statements(spark):
    got = spark.range(1).select(
        L.income_words(F.lit(100.0), F.lit(12.5), F.lit(None)).alias("a"), L.income_words(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("b"), L.balance_words(F.lit(200.0), F.lit(50.0), F.lit(150.0)).alias("c"),
        L.balance_words(F.lit(None), F.lit(1.0), F.lit(1.0)).alias("d"), L.flow_words(F.lit(1), F.lit(0), F.lit(1)).alias("e"), L.flow_words(F.lit(1), F.lit(None), F.lit(1)).alias("f"),
    ).first()
    assert got["a"] == "of 100 won sold, operations keep 12" and got["b"].startswith("no margin") and got["c"] == "debt 25 % and equity 75 % of assets"
    assert got["d"] == "no shares: assets missing" and got["e"] == f"the firm {L.OTHER_FLOW}" and got["f"].startswith("no pattern")


def test_dated_details(spark):
    cases = {("50.5%", 2024): "50.5% · 2024", ("", 2024): "2024", (None, 2024): "2024", ("50.5%", None): "50.5%", ("50.5%", 0): "50.5%", (None, None): None}
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, d string, y int").select("i", L.dated_detail("d", "y").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [*cases.values()]


def test_exact_rounding(spark):
    """As the double itself rounds, not its decimal digits."""
    values_ = [24.95, 74.65, 0.25, 0.75, 0.35, 2.675, -24.95, 0.0, 49.95, 1e6 + 0.05, 99.949999999999, None]
    rows = spark.createDataFrame([*enumerate(values_)], "i int, v double").select("i", N.rounded("v", 1).alias("r"), N.rounded("v", 2).alias("s")).orderBy("i").collect()
    assert [(r["r"], r["s"]) for r in rows] == [(None, None) if v is None else (round(v, 1), round(v, 2)) for v in values_]
    assert rows[0]["r"] == 24.9 and rows[1]["r"] == 74.7
    means = spark.range(1).select(mean_of_available([F.lit(24.9), F.lit(25.0), F.lit(None)]).alias("m")).first()["m"]
    assert means == 24.9 and spark.range(1).select(N.grade(F.lit(means)).alias("g")).first()["g"] == "F"


def test_notes_of_names(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["(주)프로젠(보통주)", "㈜가나 (주1 참조)", "나다(의결권 없는 주식)", "DB(Philippines) Inc.", "코오롱티슈진\n(주1),(주2)"])], "i int, n string")
    assert [r["v"] for r in rows.select("i", X.normal_name("n").alias("v")).orderBy("i").collect()] == ["프로젠", "가나", "나다", "db(philippines)", "코오롱티슈진"]


def test_verdicts(spark):
    pairs = {(None, 1.0): "held_missing", (1.0, None): "parsed_missing", (0.0, 0.0): "held_zero", (1000.0, 1005.0): "same", (1000.0, 1006.0): "other", (0.5, 0.504): "same"}
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, h double, p double")
    assert [r["v"] for r in rows.select("i", L.revenue_verdict("h", "p").alias("v")).orderBy("i").collect()] == [*pairs.values()]
    got = spark.createDataFrame([(70.0,), (69.9,), (40.0,), (39.0,), (None,), (float("nan"),)], "s double").select(L.score_bucket("s").alias("b")).collect()
    assert [r["b"] for r in got] == ["good", "mid", "mid", "bad", "mid", "mid"]


def test_fits(spark):
    rows = [("a", 2.0 * x - 3.0 * z + 1, float(x), float(z)) for x in range(5) for z in range(4)] + [("b", 1.0, 2.0, 4.0), ("b", 2.0, 4.0, 8.0), ("b", 3.0, 6.0, 12.0), ("b", None, 1.0, 1.0), ("c", 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "g string, y double, x double, z double")
    got = {r["g"]: (r["n"], r["coefficients"]) for r in S.linear_fits(table, "g", "y", ["x", "z"]).collect()}
    assert got["a"][0] == 20 and all(abs(v - w) < 1e-9 for v, w in zip(got["a"][1], (1, 2, -3), strict=True))
    assert got["b"] == (3, None) and got["c"] == (1, None) and got[None] == (1, None)
    assert S.linear_fits(table.where("false"), "g", "y", ["x"]).count() == 0


def test_peers_and_passes(spark):
    firms = spark.createDataFrame([("a", "k", 1), ("b", "k", 0), ("c", "k", 0), ("d", "k", 5), ("e", "m", 0), ("f", None, 0), ("g", "n", 2)], "t string, k string, tier int")
    got = {r["t"]: r["standard"] for r in S.standard_peers(firms, "t", "k", "tier").collect()}
    assert got == {"a": "b", "b": "c", "c": "b", "d": "b", "e": None, "f": None, "g": None}
    chunks = spark.createDataFrame([(i,) for i in range(5)], "c int")
    first = spark.createDataFrame([(0, "x"), (0, "y"), (0, "y"), (1, "x"), (2, None), (3, None)], "c int, f string")
    second = spark.createDataFrame([(0, "y"), (0, "x"), (1, None), (2, None)], "c int, f string")
    got = {r["c"]: (r["in_first"], r["in_second"], r["agree"]) for r in S.pass_agreement(chunks, first, second, "c", ["f"]).collect()}
    assert got == {0: (True, True, True), 1: (True, True, False), 2: (True, True, True), 3: (True, False, False), 4: (False, False, False)}


def test_summaries(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert S.overlap(a, b, "k").first().asDict() == {"both": 1, "only_ours": 1, "only_theirs": 1, "overlap_pct": 50.0}
    assert S.overlap(a, b.where("false"), "k").first()["overlap_pct"] == 0.0
    members = spark.createDataFrame([("g", 300.0, 2.0), ("g", 100.0, -5.0), ("g", None, 9.0), ("h", 500.0, 1.0), ("i", 1.0, None)], "g string, cap double, ni double")
    assert {r["g"]: r["per"] for r in S.group_price_earnings(members, "g", "cap", "ni").collect()} == {"g": 150.0, "h": None, "i": None}
    empty = spark.createDataFrame([], "total double, grade string, m1 double")
    assert S.score_summary(empty, "total", "grade", ["m1"]).first().asDict() == {"firms": 0, "scored": 0, "unscored": 0, **{f"grade_{g}": 0 for g in "ABCDF"}, "mean_m1": None, "mean_total": None}
    kinds = spark.createDataFrame([(1, "manual", "in"), (1, "associate", "out"), (1, "associate", "in"), (2, "odd", None)], "k int, kind string, dir string")
    got = {r["k"]: (r["kinds"], r["kind"], r["incoming"], r["has_equity"]) for r in S.merged_kinds(kinds, ["k"], "kind", "dir").collect()}
    assert got == {1: ("associate,manual", "associate", True, True), 2: ("odd", "odd", False, False)}
