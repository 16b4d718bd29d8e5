"""Queries of parties and of keeping relations in order, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parties as P
from ..functions.texts import first_match
from ..operators import upkeep as U
from .summaries import pick, pick_sql
from .tables import EDGES_SQL, PANEL_SQL, edges, panel, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: (name, relation, why it is no party, kind in a list of holders, kind of what is invested in)
PARTIES = (
    ("합계", None, "empty_or_total", "private_corp", "private_corp"), ("Ltd.", None, "suffix_fragment", "private_corp", "private_corp"), ("가", None, "too_short", "private_corp", "private_corp"),
    ("(4,891,807)", None, "numeric_only", "private_corp", "private_corp"), ("(단위: 원)", None, "unit_header", "private_corp", "private_corp"), ("주1) ㈜한빛", None, "footnote_prefix", "private_corp", "private_corp"),
    ("주요 주주", None, "aggregate_token", "private_corp", "private_corp"), ("㈜한빛 등 기타 104개사", None, "group_total", "private_corp", "private_corp"), ("관계기업", None, "category_label", "private_corp", "private_corp"),
    ("㈜한빛과 종속기업", None, None, "private_corp", "private_corp"), ("매출채권", None, "txn_item", "private_corp", "private_corp"), ("한빛자산운용", None, None, "private_corp", "private_corp"),
    ("이   진", "등 기 임 원", None, "person", "private_corp"), ("홍길동", "-", None, "person", "private_corp"), ("롯데물산", "자회사", None, "private_corp", "private_corp"), ("한빛1호 투자조합", None, None, "coop_fund", "coop_fund"),
    ("조달청", None, None, "public_org", "public_org"), ("Alpha Trust", None, None, "coop_fund", "coop_fund"), ("x 900101-1234567", None, None, "person", "private_corp"), ("김철수", "子", None, "person", "private_corp"), ("한빛은 흡수합병되었습니다.", None, "sentence_form", "private_corp", "private_corp"),
)
_column = lambda i: tuple(p[i] for p in PARTIES)


@query(f"SELECT p_partkey, {pick_sql(_column(2), 'p_partkey')} AS noise, {pick_sql(_column(3), 'p_partkey')} AS holder, {pick_sql(_column(4), 'p_partkey')} AS invested FROM part")
def party_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", pick(_column(0), "p_partkey").alias("n"), pick(_column(1), "p_partkey").alias("r"))
    return rows.select("p_partkey", P.no_party("n").alias("noise"), P.party_kind("n", "r", by_family_name=True).alias("holder"), P.party_kind("n", "r", may_be_person=False).alias("invested"))


@query(f"""
WITH e AS (SELECT DISTINCT src AS reporter, dst AS target, year FROM ({EDGES_SQL}) WHERE (src + dst + year) % 3 > 0), m AS (SELECT reporter, max(year) AS newest FROM e GROUP BY 1),
n AS (SELECT * FROM m WHERE reporter % 4 > 0), o AS (SELECT e.reporter, target FROM e JOIN n USING (reporter) GROUP BY e.reporter, target HAVING max(year) < any_value(newest))
SELECT e.reporter, e.target, e.year, CASE WHEN o.target IS NULL THEN NULL WHEN e.target % 7 = 0 THEN 'undecidable' WHEN e.target % 10 = e.reporter % 10 THEN 'kept' ELSE 'terminated' END AS verdict FROM e LEFT JOIN o USING (reporter, target)""")
def absent_relations(spark: SparkSession, d: str) -> DataFrame:
    # edges are one for each src, dst and year; all that follows reads the one shuffle by their ends
    rows = edges(spark, d).where("(src + dst + year) % 3 > 0").select(F.col("src").alias("reporter"), F.col("dst").alias("target"), "year").repartition("reporter", "target")
    key = F.max("reporter")  # of its group, so that what asks for a text isn't pushed into the scan of lines
    text = F.when(key % 4 > 0, F.concat(F.lit("PARTY"), (key % 10).cast("string"), F.lit("X")))
    notes = rows.groupBy("reporter").agg(F.max("year").alias("year"), text.alias("text"))
    name = F.when(F.col("target") % 7 > 0, F.concat(F.lit("PARTY"), (F.col("target") % 10).cast("string")))
    names = table(spark, d, "orders").select(F.col("o_custkey").alias("target")).select("target", name.alias("name"))  # every target has orders
    return U.absent_from_notes(rows, notes, names)


@query(f"""
WITH e AS ({EDGES_SQL}), k AS (SELECT year, src AS oa, dst AS ob, CASE WHEN src % 3 = 1 THEN src - 1 ELSE src END AS src, CASE WHEN dst % 3 = 1 THEN dst - 1 ELSE dst END AS dst, share FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, year ORDER BY oa <> src OR ob <> dst, oa, ob) AS i FROM k WHERE NOT (src = dst AND (oa <> src OR ob <> dst)))
SELECT src, dst, year, round(share, 4) AS share FROM r WHERE i = 1""")
def repointed_edges(spark: SparkSession, d: str) -> DataFrame:
    moves = table(spark, d, "customer").select(F.col("c_custkey").alias("old")).union(table(spark, d, "supplier").select("s_suppkey")).where("old % 3 = 1").select("old", (F.col("old") - 1).alias("new"))
    return U.repointed(edges(spark, d), moves, "src", "dst", ["year"]).select("src", "dst", "year", F.round("share", 4).alias("share"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def without_stale_orders(spark: SparkSession, d: str) -> DataFrame:
    touched = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return U.without_stale(table(spark, d, "orders"), touched, "o_orderpriority", ["1-URGENT", "2-HIGH"], ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("""
WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity - l_partkey % 3 * l_quantity / 2 AS a, l_linenumber % 3 AS t FROM lineitem), m AS (SELECT DISTINCT k FROM i WHERE t = 1 AND a <> 0)
SELECT k, n, a FROM i WHERE t <> 0 OR k NOT IN (SELECT k FROM m)""")
def one_basis_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") - F.col("l_partkey") % 3 * F.col("l_quantity") / 2).alias("a"),
        pick(("계속영업 기본주당이익", "중단영업 기본주당이익", "기본주당순이익"), "l_linenumber").alias("name"),
    )
    return U.one_basis(items, ["k"], "name", "a").select("k", "n", "a")


@query(f"""
WITH panel AS ({PANEL_SQL}), s AS (SELECT corp, list(revenue ORDER BY year) AS r, list(CASE WHEN corp % 5 > 0 OR year % 2 = 0 THEN operating_income END ORDER BY year) AS o, list(net_income ORDER BY year) AS n FROM panel GROUP BY 1)
SELECT corp, CASE WHEN len(list_filter(o, lambda x: x IS NULL)) = 0 THEN round(list_sum(r) - list_sum(o), 4) END AS gross, round(list_sum(r) + list_sum(n), 4) AS whole FROM s""")
def derived_totals(spark: SparkSession, d: str) -> DataFrame:
    part = F.when((F.col("corp") % 5 > 0) | (F.col("year") % 2 == 0), F.col("operating_income"))
    lists = panel(spark, d).groupBy("corp").agg(F.sort_array(F.collect_list(F.struct("year", "revenue", part.alias("o"), "net_income"))).alias("s"))
    total = lambda s: F.round(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), 4)
    return lists.select("corp", total(U.derived_series(F.col("s.revenue"), F.col("s.o"), -1)).alias("gross"), total(U.derived_series(F.col("s.revenue"), F.col("s.net_income"), 1)).alias("whole"))


#: Lists of names as notes write them, with the names, and sectors with their kinds.
LISTS = (
    ("한빛㈜, 가나㈜", ("한빛㈜", "가나㈜")), ("㈜앱(구, ㈜에이)", ()), ("Acme Co., Ltd.", ()), ("Acme Co., Ltd., Betamax Inc.", ("Acme Co., Ltd.", "Betamax Inc.")), ("Alpha Ltd.Betamax Ltd.", ("Alpha Ltd.", "Betamax Ltd.")),
    ("가(나, (다), 라)·마", ("가(나, (다), 라)", "마")), ("태양광(주)(주)이노", ("태양광(주)", "(주)이노")), (" , ", ()), (None, ()),
)
SECTORS = (("은행과 식품", "finance"), ("음료", "food"), ("전자부품", "semiconductor"), ("백화점", "retail"), ("보안", "security"), ("기계", "general"), (None, "general"))


@query(f"SELECT p_partkey, {pick_sql(tuple('|'.join(n) for _, n in LISTS), 'p_partkey')} AS names, {pick_sql(tuple(k for _, k in SECTORS), 'p_partkey')} AS kind, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS profit FROM part")
def listed_names(spark: SparkSession, d: str) -> DataFrame:
    item = lambda name, v: F.struct(F.lit(name).alias("item"), v.alias("value"))
    items = F.array(item("매출액", F.col("p_size") + 1), item(None, F.col("p_size") + 2), F.when(F.col("p_partkey") % 3 < 2, item("영업이익", F.col("p_size"))).otherwise(item("순이익", F.col("p_size"))), item("영업이익률", F.when(F.col("p_partkey") % 3 < 2, F.col("p_size"))))
    names = F.array_join(P.listed_names(pick(tuple(t for t, _ in LISTS), "p_partkey")), "|")
    return table(spark, d, "part").select("p_partkey", names.alias("names"), first_match(pick(tuple(t for t, _ in SECTORS), "p_partkey"), P.SECTOR_KINDS, "general").alias("kind"), P.first_item(items, "item", "영업이익")["value"].alias("profit"))
