"""Queries from raw relations to edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import LETTERS
from ..llm.storage import written
from ..operators import contracts as K
from ..operators import deltas as D
from ..operators import relations as R
from ..operators import silver as V
from .tables import EDGES_SQL, edges, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def registry(spark: SparkSession, d: str) -> DataFrame:
    """name and code: customers and suppliers as listed firms, but for every third and every fourth."""
    firms = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("㈜ Firm"), "c_custkey").alias("name"), F.concat(F.lit("C"), "c_custkey").alias("code"))
    return firms.union(table(spark, d, "supplier").where("s_suppkey % 4 > 0").select(F.concat(F.lit("Sup"), "s_suppkey", F.lit(" Co., Ltd.")), F.concat(F.lit("S"), "s_suppkey")))


def raw_relations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all kinds of sources out of trade: holders and investments by name, groups and filings by code, some to be
    dropped. Year and kind of stock are few, so that several rows come to one key."""
    k, src, dst = (F.col("src") + F.col("dst") + F.col("year")) % 4, F.col("src"), F.col("dst")
    by = lambda c, *values: F.get(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (c % len(values)).cast("int"))
    firm, sup = F.concat(F.lit("㈜Firm"), dst, F.lit("(주1)")), F.concat(F.lit("SUP"), src, F.lit(" 주식회사"))
    holder = by(src + dst, "보통주", "합계", sup, F.concat(F.lit("한빛"), src, F.lit("호 조합")), F.concat(F.lit("홍길동\n"), src), firm)
    target = by(src * 3 + dst, "HMA", firm, "Ltd.", F.concat(F.lit("해외"), dst, F.lit(" 법인(비상장)")), sup)
    code = F.concat(F.lit("S"), src)
    rows = edges(spark, d).select(
        (src * 10_000_000 + dst * 10 + F.col("year") - 1990).alias("id"), by(k, V.HOLDERS, V.INVESTED, V.GROUPS, V.FILINGS).alias("source_type"),
        by(k, holder, sup, code, code).alias("source_name"), by(k, firm, target, F.concat(F.lit("C"), dst), F.concat(F.lit("C"), dst)).alias("target_name"),
        by(src, "본인", "계열회사", "-").alias("relate"), F.round(F.when(src % 7 > 0, F.col("share")) * F.when(dst % 9 == 0, 300).otherwise(1), 4).alias("ratio"), by(dst + F.col("year"), "보통주", "우선주", F.lit(None).cast("string")).alias("stock_kind"),
        (F.lit(2020) + F.col("year") % 2).cast("int").alias("year"), F.concat(F.lit('{"group_name": "G'), (src % 5).cast("string"), F.lit('"}')).alias("raw_response"),
    )
    return rows


def _judged(spark: SparkSession, d: str) -> DataFrame:
    listed = registry(spark, d)
    blocked = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("source"), F.concat(F.lit("C"), F.col("s_suppkey") + 1).alias("target"))
    overrides = table(spark, d, "customer").where("c_custkey % 11 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("code"), F.concat(F.lit("own"), "c_nationkey").alias("group_name"))
    return V.judged(raw_relations(spark, d), listed, blocked, overrides)


#: The same in DuckDB: a name as written and as it is looked up, and what follows.
JUDGED_SQL = f"""
SELECT *, CASE WHEN t = 0 THEN CASE WHEN n = 0 THEN 'stock_kind_row' WHEN a IS NULL OR b IS NULL THEN 'unmatched' WHEN a = b THEN 'self_loop' ELSE 'kept_ownership' END
  WHEN t = 1 THEN CASE WHEN sup IS NULL THEN 'unmatched' WHEN ratio > 100 THEN 'ratio_invalid' WHEN b IS NULL THEN 'unmatched' WHEN b = 'C' || (src + 1) THEN 'blocklist' WHEN a = b THEN 'own' ELSE 'kept_ownership' END
  WHEN a IS NULL OR b IS NULL THEN CASE WHEN t = 2 THEN 'unmatched' ELSE 'ignored' END WHEN t = 2 THEN 'kept_ftc' ELSE 'kept_filing' END AS fate,
  CASE WHEN t = 0 AND n IN (2, 3, 4, 5) AND firm IS NOT NULL AND left(a, 2) = 'x_' THEN a WHEN t = 1 AND sup IS NOT NULL AND NOT coalesce(ratio > 100, FALSE) AND left(b, 2) = 'x_' THEN b END AS node
FROM (SELECT *,
  CASE WHEN t = 0 THEN CASE n WHEN 2 THEN coalesce(sup, 'x_' || left(sha1(firm || '|sup' || src), 12)) WHEN 3 THEN 'x_' || left(sha1(firm || '|한빛' || src || '호조합'), 12) WHEN 4 THEN 'x_' || left(sha1(firm || '|홍길동' || src), 12) WHEN 5 THEN firm END ELSE sup END AS a,
  CASE WHEN t = 1 THEN CASE m WHEN 0 THEN 'x_' || left(sha1(sup || '|hma'), 12) WHEN 1 THEN coalesce(firm, 'x_' || left(sha1(sup || '|firm' || dst), 12)) WHEN 3 THEN 'x_' || left(sha1(sup || '|해외' || dst || '법인'), 12) WHEN 4 THEN sup END ELSE firm END AS b
FROM (SELECT src, dst, (src + dst + year) % 4 AS t, (src + dst) % 6 AS n, (src * 3 + dst) % 5 AS m, src * 10000000 + dst * 10 + year - 1990 AS id, 2020 + year % 2 AS year, (dst + year) % 3 AS stock,
  round(CASE WHEN src % 7 > 0 THEN share END * CASE WHEN dst % 9 = 0 THEN 300 ELSE 1 END, 4) AS ratio, CASE WHEN src % 4 > 0 THEN 'S' || src END AS sup, CASE WHEN dst % 3 > 0 THEN 'C' || dst END AS firm FROM ({EDGES_SQL})))"""

_SOURCES = f"['{V.HOLDERS}', '{V.INVESTED}', '{V.GROUPS}', '{V.FILINGS}'][t + 1]"

KEPT_SQL = f"""
SELECT a AS source, b AS target, {_SOURCES} AS source_type, year, CASE t WHEN 2 THEN 'ftc_group' WHEN 3 THEN 'dart_filing' ELSE 'ownership' END AS relation, CASE WHEN t < 2 THEN ratio END AS ratio,
  CASE WHEN t = 2 THEN CASE WHEN dst % 11 = 0 THEN 'own' || c_nationkey ELSE 'G' || src % 5 END END AS group_name
FROM (SELECT *, row_number() OVER (PARTITION BY a, b, t, year ORDER BY CASE WHEN t > 0 THEN 1 ELSE [0, 2, 1][stock + 1] END, ratio DESC NULLS LAST, id DESC) AS i FROM ({JUDGED_SQL}) WHERE fate LIKE 'kept%') LEFT JOIN customer ON c_custkey = dst WHERE i = 1"""


@query(KEPT_SQL)
def silver_edges(spark: SparkSession, d: str) -> DataFrame:
    return V.silver_edges(_judged(spark, d))


@query(f"""
SELECT node AS uid, any_value(CASE WHEN t = 0 THEN firm ELSE sup END) AS anchor, any_value(CASE WHEN t = 0 THEN CASE n WHEN 2 THEN 'SUP' || src || ' 주식회사' WHEN 3 THEN '한빛' || src || '호 조합' ELSE '홍길동 ' || src END
    WHEN m = 0 THEN 'HMA' WHEN m = 1 THEN '㈜Firm' || dst ELSE '해외' || dst || ' 법인' END) AS name, any_value(CASE WHEN t = 0 THEN ['본인', '계열회사', '-'][src % 3 + 1] END) AS relate, arg_min({_SOURCES} || ':' || year, id) AS first_seen,
  any_value(CASE WHEN t = 0 AND n = 3 THEN 'coop_fund' ELSE 'private_corp' END) AS kind
FROM ({JUDGED_SQL}) WHERE node IS NOT NULL GROUP BY 1""")
def silver_nodes(spark: SparkSession, d: str) -> DataFrame:
    return V.silver_nodes(_judged(spark, d))


@query(f"""
WITH j AS ({JUDGED_SQL}), k AS ({KEPT_SQL})
SELECT {", ".join(f"count(*) FILTER (WHERE fate = '{fate}') AS {name}" for fate, name in V.FATES.items())}, count(*) FILTER (WHERE t = 1 AND m IN (0, 2) AND sup IS NOT NULL AND NOT coalesce(ratio > 100, FALSE)) AS queued_ambiguous, count(node) AS unlisted_nodes,
  0 AS dropped_personal, 0 AS dropped_foundation, (SELECT count(*) FROM (SELECT DISTINCT source, target, source_type, year + 1 AS year FROM k WHERE source_type <> '{V.FILINGS}' EXCEPT SELECT source, target, source_type, year FROM k)) AS pruned_stale,
  (SELECT count(*) FROM (SELECT node FROM j WHERE node IS NOT NULL UNION SELECT 'x_' || s_suppkey FROM supplier EXCEPT (SELECT source FROM k UNION SELECT target FROM k))) AS pruned_orphan_nodes, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS kind_reconciled
FROM j""")
def silver_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_judged(spark, d).select("id", *V.KEY, "stock", "ratio", "group_name", "fate", "queued", "node"), "judged")
    old = V.silver_edges(rows).select("source", "target", "source_type", (F.col("year") + 1).alias("year"))
    stored = F.when(F.col("s_suppkey") % 2 == 0, "person").otherwise("private_corp")
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("x_"), "s_suppkey").alias("uid"), F.concat(F.lit("S"), "s_suppkey").alias("anchor"), F.lit("기계상사").alias("name"), F.lit(None).cast("string").alias("relate"), F.lit("note").alias("first_seen"), stored.alias("kind"))
    return V.counters(rows, old, nodes)


#: What Latin letters are called, as a map of DuckDB's, and a name spelled by it.
_CALLED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LETTERS.items()) + "}"
_spelled = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: {_CALLED}[c]), '')"


def listed_firms(spark: SparkSession, d: str) -> DataFrame:
    """name and code of customers: two letters of the segment and a few of the keys' digits, so that some names are shared;
    every tenth has the name that another is called by."""
    latin = F.substring("c_mktsegment", 1, 2)
    spelled = F.array_join(F.transform(F.split(latin, ""), lambda c: F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))[c]), "")
    named = F.concat(F.when(F.col("c_custkey") % 10 == 0, spelled).otherwise(latin), (F.col("c_custkey") % 700).cast("string"), F.lit("전자"))
    return table(spark, d, "customer").select(named.alias("name"), F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("code"))


@query(f"""
WITH f AS (SELECT left(c_mktsegment, 2) AS l, {_spelled("left(c_mktsegment, 2)")} AS s, c_custkey % 700 AS n, c_custkey % 10 = 0 AS k, 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code FROM customer),
r AS (SELECT lower(CASE WHEN k THEN s ELSE l END) || n || '전자' AS name, max(code) AS code FROM f GROUP BY 1), c AS (SELECT s || n || '전자' AS name, min(code) AS code FROM f WHERE NOT k GROUP BY 1 HAVING min(code) = max(code)),
b AS (SELECT * FROM r UNION ALL SELECT * FROM c WHERE name NOT IN (SELECT name FROM r)),
a AS (SELECT o_orderkey, ['au', '에이유', 'ma', '엠에이', 'fu'][CAST(o_orderkey % 5 AS INTEGER) + 1] || o_custkey % 900 || '전자' AS name FROM orders WHERE o_orderkey % 11 > 0)
SELECT o_orderkey, code, code IS NULL AS queued FROM a LEFT JOIN b USING (name)""")
def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Names on orders, written in either way, by the book of all firms."""
    begins = F.get(F.array(*map(F.lit, ("㈜AU", "에이유 ", "Ma", "엠에이", "FU"))), (F.col("o_orderkey") % 5).cast("int"))
    asked = table(spark, d, "orders").where("o_orderkey % 11 > 0").select("o_orderkey", F.concat(begins, (F.col("o_custkey") % 900).cast("string"), F.lit("전자(주1)")).alias("name"))
    return R.resolved(asked, "name", R.name_book(listed_firms(spark, d), "name", "code")).select("o_orderkey", "code", "queued")


#: Balances of customers as two runs of scores: some are only in one, some have none.
_RUNS_SQL = """
WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 13 > 0 THEN c_acctbal END AS s FROM customer WHERE c_custkey % 9 > 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 17 > 0 THEN c_acctbal + c_custkey % 101 - 40 END AS s FROM customer WHERE c_custkey % 8 > 0),
b AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.s AS old_score, n.s AS new_score, n.s - o.s AS delta, CASE WHEN o.c_custkey IS NULL THEN 'new' WHEN n.c_custkey IS NULL THEN 'gone' WHEN o.s IS NOT NULL AND n.s IS NOT NULL THEN 'common' WHEN n.s IS NOT NULL THEN 'scored' WHEN o.s IS NOT NULL THEN 'lost' ELSE 'unscored' END AS state FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    firms = table(spark, d, "customer")
    old = firms.where("c_custkey % 9 > 0").select("c_custkey", F.when(F.col("c_custkey") % 13 > 0, F.col("c_acctbal")).alias("s"))
    new = firms.where("c_custkey % 8 > 0").select("c_custkey", F.when(F.col("c_custkey") % 17 > 0, F.col("c_acctbal") + F.col("c_custkey") % 101 - 40).alias("s"))
    return D.compared_scores(old, new, "c_custkey", "s")


@query(_RUNS_SQL + """
SELECT count(*) FILTER (WHERE state = 'common') AS common, count(*) FILTER (WHERE state = 'new') AS new, count(*) FILTER (WHERE state = 'gone') AS gone, count(*) FILTER (WHERE state = 'scored') AS scored, count(*) FILTER (WHERE state = 'lost') AS lost, count(*) FILTER (WHERE state = 'unscored') AS unscored,
  round(avg(delta), 4) AS mean_delta, round(quantile_cont(delta, 0.5), 4) AS median_delta, round(max(abs(delta)), 4) AS largest FROM b""")
def score_deltas(spark: SparkSession, d: str) -> DataFrame:
    found = D.delta_summary(_runs(spark, d))
    return found.select(*(F.round(c, 4).alias(c) if c in ("mean_delta", "median_delta", "largest") else F.col(c) for c in found.columns))


@query(_RUNS_SQL + """
SELECT c_custkey, round(delta, 4) AS delta, row_number() OVER (ORDER BY abs(round(delta, 6)) DESC, c_custkey) AS place FROM b WHERE delta IS NOT NULL QUALIFY place <= 20""")
def largest_moves(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).withColumn("delta", F.round("delta", 6))
    return D.largest_moves(rows, "c_custkey").select("c_custkey", F.round("delta", 4).alias("delta"), "place")


def contract_filings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as filings of contracts by suppliers: rows in one of two orders, amounts total or confirmed, names as written,
    strange or absent."""
    o = F.col("o_orderkey")
    row = lambda *cells: F.concat(F.lit("<TR>"), *(x for c in cells for x in (F.lit("<TD>"), F.lit(c) if isinstance(c, str) else c, F.lit("</TD>"))), F.lit("</TR>"))
    price = F.format_number(F.floor("o_totalprice"), 0)
    amount = F.when(o % 4 == 0, F.concat(row("2. 계약내역", "계약금액 총액 (원)", "-"), row("확정 계약금액", price))).when(o % 4 == 1, row("계약금액 총액(원)", price)).when(o % 4 == 2, row("2. 계약내역", "<B>계약금액 총액</B>(원)", price)).otherwise(row("매출액 대비", "5.0"))
    name = F.when(o % 7 == 0, "-").when(o % 7 == 1, "방산 솔루션 공급 업체").otherwise(F.concat(F.lit("㈜ Firm"), F.col("o_custkey")))
    party = F.when(o % 9 == 0, F.lit("")).otherwise(row("3. 계약상대방", name))
    dates = F.concat(row("5. 계약기간", "시작일", F.date_format("o_orderdate", "yyyy-MM-dd")), row("종료일", F.when(o % 3 > 0, F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd")).otherwise("-")), F.when(o % 5 > 0, row("8. 계약(수주)일자", F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(""))
    text = F.when(o % 2 == 0, F.concat(amount, party, dates)).otherwise(F.concat(dates, party, amount))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), o % 500 + 1).alias("reporter"), text.alias("text"), F.date_add("o_orderdate", 400).alias("received"))


@query("""
WITH o AS (SELECT *, o_orderkey AS k, 'C' || (o_orderkey % 500 + 1) AS source, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '-' WHEN o_orderkey % 7 = 1 THEN '방산 솔루션 공급 업체' ELSE '㈜ Firm' || o_custkey END AS counterparty, CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 7 > 1 AND o_orderkey % 9 > 0 THEN 'C' || o_custkey END AS code FROM orders)
SELECT o_orderkey, source, CASE WHEN code <> source THEN code END AS target, CASE WHEN counterparty IS NULL THEN 'no_counterparty' WHEN code IS NULL THEN 'link_failed' WHEN code = source THEN 'own' ELSE 'kept' END AS fate, CASE WHEN k % 4 < 3 THEN floor(o_totalprice) END AS amount,
  year(CASE WHEN k % 5 > 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 400 END) AS year, CASE WHEN k % 3 > 0 THEN strftime(CAST(o_orderdate AS DATE) + 90, '%Y-%m-%d') END AS valid_until FROM o""")
def contract_edges(spark: SparkSession, d: str) -> DataFrame:
    filed = contract_filings(spark, d)
    forms = K.contract_forms(filed, "o_orderkey", "text", F.col("received")).join(filed.select("o_orderkey", "reporter"), "o_orderkey")
    return K.contract_edges(forms, R.name_book(registry(spark, d), "name", "code"), "reporter", "o_orderkey").select("o_orderkey", "source", "target", "fate", "amount", "year", "valid_until")
