"""Queries of labels and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import earnings as Q
from ..operators import summaries as S
from .domain import ORACLES as DOMAIN_SQL
from .tables import EDGES_SQL, PANEL_SQL, edges, panel, rounded_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pick(texts: tuple, key: str):
    """The text of a key, by turns; null for None."""
    return F.get(F.array(*(F.lit(t).cast("string") for t in texts)), (F.col(key) % len(texts)).cast("int"))


def pick_sql(texts: tuple, key: str) -> str:
    return "[" + ", ".join("NULL" if t is None else "'" + t + "'" for t in texts) + f"][CAST({key} % {len(texts)} AS INTEGER) + 1]"


#: Beginnings of the parts' names, by key.
NAMES = ("CJ제일", "LTD. LG 전자(*3)", "Motor ", "㈜삼성 (주1)", "SK·KT ,", "Global GS(보통주)", "한빛*", "CO.,가나 ※2", None)


@query(f"""
WITH p AS (SELECT p_partkey, {pick_sql(NAMES, "p_partkey")} AS n FROM part), m AS (SELECT MAP {{{", ".join(f"'{k}': '{v}'" for k, v in L.LETTERS.items())}}} AS m),
s AS (SELECT *, CASE WHEN n IS NOT NULL THEN list_reduce(list_concat([n], list_filter(regexp_extract_all(n, '[A-Za-z]+'), lambda r: len(r) <= 4)), lambda a, r: replace(a, r, array_to_string(list_transform(string_split(upper(r), ''), lambda c: m[c]), ''))) END AS spoken FROM p, m)
SELECT p_partkey, CASE WHEN spoken <> n THEN spoken END AS spoken, CASE p_partkey % 9 WHEN 0 THEN 'CJ제일' WHEN 1 THEN 'LG 전자' WHEN 2 THEN 'Motor' WHEN 3 THEN '㈜삼성' WHEN 4 THEN 'SK·KT' WHEN 5 THEN 'Global GS' WHEN 6 THEN '한빛' WHEN 7 THEN 'CO.,가나' ELSE '' END AS shown FROM s""")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", pick(NAMES, "p_partkey").alias("n"))
    return named.select("p_partkey", L.spoken_name("n").alias("spoken"), L.shown_name("n").alias("shown"))


#: Words of all endings.
WORDS = ("삼성", "서울", "가나", "1", "12)", "LG", "전남.", "5%", "")


@query(f"""
WITH w AS (SELECT p_partkey, {pick_sql(WORDS, "p_partkey")} AS w FROM part), l AS (SELECT *, right(regexp_replace(trim(w), '[\\])}}·.,%]+$', ''), 1) AS c FROM w),
e AS (SELECT *, c IN ('0', '1', '3', '6', '7', '8') OR (c >= '가' AND c <= '힣' AND (unicode(c) - 44032) % 28 <> 0) AS k, c IN ('1', '7', '8') OR (c >= '가' AND c <= '힣' AND (unicode(c) - 44032) % 28 = 8) AS r FROM l)
SELECT p_partkey, w || CASE WHEN k THEN '은' ELSE '는' END AS topic, w || CASE WHEN k THEN '이' ELSE '가' END AS subject, '[' || w || ']' || CASE WHEN k THEN '을' ELSE '를' END AS object, w || CASE WHEN k AND NOT r THEN '으로' ELSE '로' END AS way FROM e""")
def particles(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select("p_partkey", pick(WORDS, "p_partkey").alias("w"))
    return words.select("p_partkey", L.with_particle("w", "은는").alias("topic"), L.with_particle("w", "이가").alias("subject"), L.with_particle("w", "을를", boxed=True).alias("object"), L.with_particle("w", "으로").alias("way"))


#: Classes as notes write them, and what they are shown as.
DETAILS = ("사업보고서 주석: 지배기업", "대규모기업집단(*1) (그룹 합산)", "기  타", "최상위 지배기업", "주석: (*3)", "공동기업 (별도)", "임원: A:B", None)
SHOWN = ("지배기업", "대규모기업집단 (그룹 합산)", "기타", "최상위 지배기업", "특수관계자", "관계기업 (별도)", "A B", "특수관계자")


@query(f"""
WITH s AS (SELECT *, {pick_sql(SHOWN, "s_suppkey")} AS v FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 40 AS DOUBLE) / 4 || '%' WHEN s_suppkey % 3 = 0 THEN 'G ' || s_nationkey ELSE v END || CASE WHEN s_suppkey % 4 > 0 THEN ' · ' || (2020 + s_suppkey % 4) ELSE '' END AS detail FROM s""")
def edge_details(spark: SparkSession, d: str) -> DataFrame:
    share = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") % 40 / 4)
    group = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("G:"), F.col("s_nationkey")))
    year = F.when(F.col("s_suppkey") % 4 > 0, F.lit(2020) + F.col("s_suppkey") % 4)
    return table(spark, d, "supplier").select("s_suppkey", L.dated_detail(L.edge_detail(share, group, pick(DETAILS, "s_suppkey"), F.lit(True)), year).alias("detail"))


#: Labels of columns in notes.
FLOW_LABELS = ("대여거래,대여", "대여거래,회수", "차입", "대여,차입", "출자, 기타", " 현금출자 ", "대여금", "", "차입거래,이자비용", None)
FLOW_WAYS = ("capital_out", None, "capital_in", None, "capital_out", "capital_out", None, None, None, None)


@query(f"SELECT p_partkey, {pick_sql(FLOW_WAYS, 'p_partkey')} AS direction FROM part")
def capital_directions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", L.capital_direction(pick(FLOW_LABELS, "p_partkey")).alias("direction"))


_WHOLE = "CAST(CAST(round_even({}, 0) AS BIGINT) AS VARCHAR)".format


@query(f"""
WITH panel AS ({PANEL_SQL}), r AS (SELECT *, operating_income / nullif(revenue, 0) * 100 AS om, net_income / nullif(revenue, 0) * 100 AS nm, total_liabilities / nullif(total_assets, 0) * 100 AS dr, total_equity / nullif(total_assets, 0) * 100 AS er,
  CASE WHEN corp % 4 > 0 THEN concat(CASE WHEN operating_cashflow > 0 THEN '+' WHEN operating_cashflow < 0 THEN '-' ELSE '0' END, CASE WHEN corp % 2 = 0 THEN '-' ELSE '+' END, CASE WHEN year % 3 = 0 THEN '0' WHEN year % 3 = 1 THEN '-' ELSE '+' END) END AS f FROM panel)
SELECT corp, year, CASE WHEN om IS NULL THEN 'no margin: sales or operating income missing' ELSE 'of 100 won sold, operations keep ' || {_WHOLE("om")} || coalesce(', ' || {_WHOLE("nm")} || ' after all else', '') END AS income,
  CASE WHEN coalesce(total_assets, 0) = 0 THEN 'no shares: assets missing' ELSE 'debt ' || {_WHOLE("dr")} || ' %' || coalesce(' and equity ' || {_WHOLE("er")} || ' %', '') || ' of assets' END AS balance,
  CASE WHEN f IS NULL THEN 'no pattern: a flow is missing' ELSE 'the firm ' || CASE f {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.FLOWS.items())} ELSE '{L.OTHER_FLOW}' END END AS flows FROM r""")
def statement_words(spark: SparkSession, d: str) -> DataFrame:
    investing = F.when(F.col("corp") % 4 > 0, F.when(F.col("corp") % 2 == 0, -1).otherwise(1))
    financing = F.when(F.col("year") % 3 == 0, 0).when(F.col("year") % 3 == 1, -1).otherwise(1)
    return panel(spark, d).select("corp", "year", L.income_words("revenue", "operating_income", "net_income").alias("income"), L.balance_words("total_assets", "total_liabilities", "total_equity").alias("balance"), L.flow_words("operating_cashflow", investing, financing).alias("flows"))


#: Holders and their relations, and titles with what is there already.
HOLDERS = ("홍길동", "(주)한빛", "김 철수", "한빛전자산업", "x 900101-1234567", "이영희", None)
RELATIONS = (None, None, "최대주주 본인", None, "계열", "계열회사", "본인")


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, s_suppkey % 7 IN (0, 2, 4) AS person, CASE WHEN s_suppkey % 11 = 0 OR s_acctbal / 100 >= 40 AND s_acctbal / 100 < 70 THEN 'mid' WHEN s_acctbal / 100 >= 70 THEN 'good' ELSE 'bad' END AS bucket,
  CASE WHEN s_suppkey % 11 = 0 THEN 'held_missing' WHEN s_suppkey % 13 = 0 THEN 'parsed_missing' WHEN s_acctbal = 0 THEN 'held_zero' WHEN abs(s_acctbal + s_suppkey % 60 - s_acctbal) / greatest(abs(s_acctbal), 1.0) <= 0.005 THEN 'same' ELSE 'other' END AS verdict,
  s_suppkey % 4 IN (0, 1) AS redundant, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'named_kw' ELSE 'named_only' END ELSE 'kw_only' END AS stratum FROM supplier""")
def small_verdicts(spark: SparkSession, d: str) -> DataFrame:
    code, balance = F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.when(F.col("s_suppkey") % 11 != 0, F.col("s_acctbal"))
    parsed = F.when(F.col("s_suppkey") % 13 != 0, F.col("s_acctbal") + F.col("s_suppkey") % 60)
    titles, held = pick(("반도체 · 디램", "디램", "가전", " · "), "s_suppkey"), F.array(F.lit("디램·반도체·낸드"), F.lit("휴대폰"), F.lit(""))
    return table(spark, d, "supplier").select(
        "s_suppkey", L.guessed_market(code).alias("market"), L.is_person(pick(HOLDERS, "s_suppkey"), pick(RELATIONS, "s_suppkey")).alias("person"), L.score_bucket(balance / 100).alias("bucket"), L.revenue_verdict(balance, parsed).alias("verdict"),
        L.overlaps_category(titles, held).alias("redundant"), L.sample_stratum(F.col("s_suppkey") % 2 == 0, pick(("원재료 매입", "없음", "없음"), "s_suppkey"), ["매입", "공급"]).alias("stratum"),
    )


@query(f"""
WITH panel AS ({PANEL_SQL}), r AS (SELECT g2, operating_income / nullif(revenue, 0) * 100 AS om, net_income / nullif(revenue, 0) * 100 AS nm, CASE WHEN corp % 3 > 0 THEN total_equity / nullif(total_assets, 0) * 100 END AS er FROM panel WHERE g2 <> 'KSIC-66')
SELECT g2 AS sector, count(*) AS firms, round(avg(om), 4) AS om, round(avg(nm), 4) AS nm, round(avg(er), 4) AS er FROM r GROUP BY 1""")
def sector_means(spark: SparkSession, d: str) -> DataFrame:
    sector = F.when(F.col("groups")[1] != "KSIC-66", F.col("groups")[1]).alias("sector")
    om, nm = S.per_hundred(["operating_income", "net_income"], "revenue")
    rows = panel(spark, d).select("corp", sector, om.alias("om"), nm.alias("nm"), F.when(F.col("corp") % 3 > 0, S.per_hundred(["total_equity"], "total_assets")[0]).alias("er"))
    means = S.group_means(rows, "sector", ["om", "nm", "er"])
    return means.select("sector", "firms", *(F.round(c, 4).alias(c) for c in ("om", "nm", "er")))


@query(f"""
WITH q AS ({DOMAIN_SQL["quality_scores"]})
SELECT count(*) AS firms, count(total) AS scored, count(*) - count(total) AS unscored, {", ".join(f"count(*) FILTER (WHERE total IS NOT NULL AND grade = '{g}') AS grade_{g}" for g in "ABCDF")}, {", ".join(rounded_sql(f"avg(m{i}) FILTER (WHERE total IS NOT NULL)", 1) + f" AS mean_m{i}" for i in range(1, 6))}, {rounded_sql("avg(total)", 1)} AS mean_total FROM q""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    firms_ = panel(spark, d)
    return S.score_summary(Q.quality_scores(firms_, Q.calibrated(firms_, 20, 8)), "total", "grade", [f"m{i}" for i in range(1, 6)])


@query(f"""
WITH q AS ({DOMAIN_SQL["quality_scores"]}), l AS (SELECT unnest(['m1', 'm2', 'm3', 'm4', 'm5']) AS module, unnest([m1, m2, m3, m4, m5]) AS v FROM q)
SELECT module, CAST(count(*) - count(v) AS BIGINT) AS missing FROM l GROUP BY 1""")
def missing_modules(spark: SparkSession, d: str) -> DataFrame:
    firms_ = panel(spark, d)
    return S.missing_counts(Q.quality_scores(firms_, Q.calibrated(firms_, 20, 8)), [f"m{i}" for i in range(1, 6)])


@query("""
WITH c AS (SELECT o_custkey % 40 AS g, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS cap, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS income FROM orders GROUP BY o_custkey),
s AS (SELECT g, sum(cap) FILTER (WHERE cap > 0 AND income > 0) / sum(income) FILTER (WHERE cap > 0 AND income > 0) AS per FROM c GROUP BY 1)
SELECT g, CASE WHEN per > 0 AND per < 200 THEN round(per, 1) END AS per FROM s""")
def group_price_earnings(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    firms_ = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("cap"), F.sum(sign * F.round("o_totalprice").cast("long")).cast("double").alias("income"))
    return S.group_price_earnings(firms_.withColumn("g", F.col("o_custkey") % 40), "g", "cap", "income")


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer), j AS (SELECT o.k AS o, c.k AS c FROM o FULL JOIN c USING (k)), n AS (SELECT count(*) FILTER (WHERE o IS NOT NULL AND c IS NOT NULL) AS "both", count(*) FILTER (WHERE c IS NULL) AS only_ours, count(*) FILTER (WHERE o IS NULL) AS only_theirs FROM j)
SELECT *, coalesce(round("both" * 100.0 / nullif("both" + only_theirs, 0), 1), 0.0)::DOUBLE AS overlap_pct FROM n""")
def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    return S.overlap(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber < 4), b AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f FROM lineitem WHERE l_linenumber <> 2 AND l_orderkey % 5 <> 0),
x AS (SELECT k, list(f ORDER BY f) AS l FROM a GROUP BY 1), y AS (SELECT k, list(f ORDER BY f) AS l FROM b GROUP BY 1)
SELECT o_orderkey, x.k IS NOT NULL AS in_first, y.k IS NOT NULL AS in_second, coalesce(x.l = y.l, false) AS agree FROM orders LEFT JOIN x ON x.k = o_orderkey LEFT JOIN y ON y.k = o_orderkey""")
def pass_agreement(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("f"), "l_linenumber")
    return S.pass_agreement(table(spark, d, "orders"), lines.where("l_linenumber < 4"), lines.where("l_linenumber <> 2 AND o_orderkey % 5 <> 0"), "o_orderkey", ["f"])


@query("""
WITH f AS (SELECT c_custkey, c_mktsegment || c_nationkey % 3 AS cluster, c_nationkey % 4 AS tier FROM customer)
SELECT c_custkey, cluster, (SELECT min(ROW(g.tier, g.c_custkey)) FROM f g WHERE g.cluster = f.cluster AND g.tier <= 1 AND g.c_custkey <> f.c_custkey)[2] AS standard FROM f""")
def standard_peers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", (F.col("c_nationkey") % 3).cast("string")).alias("cluster"), (F.col("c_nationkey") % 4).alias("tier"))
    return S.standard_peers(rows, "c_custkey", "cluster", "tier")


@query("""
WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem)
SELECT g, count(*) AS n, round(regr_intercept(y, x), 3) AS base, round(regr_slope(y, x), 5) AS slope FROM r GROUP BY 1""")
def linear_fits(spark: SparkSession, d: str) -> DataFrame:
    fits = S.linear_fits(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", ["l_quantity"])
    return fits.select(F.col("l_returnflag").alias("g"), "n", F.round(F.col("coefficients")[0], 3).alias("base"), F.round(F.col("coefficients")[1], 5).alias("slope"))


@query(f"""
WITH e AS ({EDGES_SQL}), k AS (SELECT src, dst, ['manual', 'associate', 'ftc_group', 'subsidiary', 'dart_filing', 'other'][CAST(year % 6 AS INTEGER) + 1] AS kind, (src + year) % 2 = 0 AS i FROM e),
o AS (SELECT src, dst, kind, max(i) AS i, coalesce(nullif(coalesce(list_position(['subsidiary', 'associate', 'investment', 'ftc_group', 'dart_filing', 'manual'], kind), 0), 0), 9) AS r FROM k GROUP BY 1, 2, 3)
SELECT src, dst, string_agg(kind, ',' ORDER BY r, kind) AS kinds, first(kind ORDER BY r, kind) AS kind, first(i ORDER BY r, kind) AS incoming, bool_or(kind IN ('subsidiary', 'associate', 'investment')) AS has_equity FROM o GROUP BY 1, 2""")
def merged_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = pick(("manual", "associate", "ftc_group", "subsidiary", "dart_filing", "other"), "year")
    rows = edges(spark, d).select("src", "dst", kind.alias("kind"), F.when((F.col("src") + F.col("year")) % 2 == 0, "in").otherwise("out").alias("dir"))
    return S.merged_kinds(rows, ["src", "dst"], "kind", "dir")


@query(f"""
WITH panel AS ({PANEL_SQL}), w AS (SELECT corp, year, (corp + year) % 5 > 0 OR corp % 7 = 0 AS w FROM panel)
SELECT corp, min(year) FILTER (WHERE w) AS "first", bool_and(w) AS "full", count(*) FILTER (WHERE w) AS complete FROM w GROUP BY 1""")
def complete_years(spark: SparkSession, d: str) -> DataFrame:
    gap = F.when(((F.col("corp") + F.col("year")) % 5 > 0) | (F.col("corp") % 7 == 0), F.col("operating_income"))
    return S.complete_years(panel(spark, d).withColumn("operating_income", gap), "corp", "year", ["operating_cashflow", "operating_income", "net_income"])
