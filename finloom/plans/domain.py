"""Queries of the analysis itself: earnings quality, relations, statements, texts and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import industries as I
from ..functions import numbers as N
from ..functions import texts as X
from ..operators import chunks as C
from ..operators import disclosures as T
from ..operators import earnings as Q
from ..operators import evaluation as V
from ..operators import financials as B
from ..operators import keyed as K
from ..operators import relations as R
from ..operators import statements as S
from .tables import EDGES_SQL, PANEL_SQL, cents, edges, exactly, firms, panel, rounded_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


METRICS_SQL = f"""
WITH panel AS ({PANEL_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY year DESC) AS b FROM panel), l AS (SELECT *, operating_income / nullif(revenue, 0) AS mg FROM b WHERE b <= 3),
w AS (SELECT *, CASE WHEN mg IS NOT NULL THEN row_number() OVER (PARTITION BY corp, mg IS NULL ORDER BY year) END AS w FROM l),
a AS (SELECT corp, max_by(g1, year) AS g1, max_by(g2, year) AS g2, max_by(g3, year) AS g3, count(*) AS years,
  sum(operating_cashflow) AS ocf, sum(operating_income) AS oi, count(operating_income) AS pairs,
  max(CASE WHEN b = 1 THEN receivable END) AS r1, max(CASE WHEN b = 2 THEN receivable END) AS r2, max(CASE WHEN b = 1 THEN revenue END) AS v1, max(CASE WHEN b = 2 THEN revenue END) AS v2,
  max(CASE WHEN b = 1 THEN total_liabilities END) AS debt, max(CASE WHEN b = 1 THEN total_equity END) AS e1, max(CASE WHEN b = 2 THEN total_equity END) AS e2, max(CASE WHEN b = 3 THEN total_equity END) AS e3,
  count(mg) AS margins, sum(mg * w) / sum(w) AS mean, max(mg) - min(mg) AS rng FROM w GROUP BY corp),
c AS (SELECT *, CASE WHEN years >= 3 THEN e3 ELSE e2 END AS early FROM a),
m AS (SELECT corp, g1, g2, g3, years >= 3 AS three, e1, early, CASE WHEN pairs >= 2 AND oi > 0 THEN ocf / oi END AS cash_ratio,
  CASE WHEN g3 <> 'FINANCIAL' AND v1 <> 0 THEN r1 / nullif(r2, 0) - 1 - (v1 / nullif(v2, 0) - 1) END AS receivable_gap, CASE WHEN e1 > 0 THEN debt / e1 END AS leverage,
  CASE WHEN margins >= 2 THEN mean END AS margin, CASE WHEN margins >= 2 THEN rng END AS margin_range,
  CASE WHEN e1 > 0 AND early > 0 THEN pow(e1 / early, CASE WHEN years >= 3 THEN 0.5 ELSE 1.0 END) - 1 END AS equity_growth FROM c),
u AS (SELECT corp, g1, g2, g3, three, metric, value FROM (UNPIVOT m ON receivable_gap, leverage, margin, margin_range, equity_growth INTO NAME metric VALUE value)),
x AS (SELECT corp, metric, unnest([g1, g2, g3]) AS grp, unnest([0, 1, 2]) AS pos, CASE WHEN metric = 'equity_growth' AND NOT three THEN NULL ELSE value END AS fit, value FROM u),
p AS (SELECT grp, metric, count(fit) AS n, quantile_cont(fit, 0.1) AS p1, quantile_cont(fit, 0.25) AS p2, quantile_cont(fit, 0.5) AS p3, quantile_cont(fit, 0.75) AS p4, quantile_cont(fit, 0.9) AS p5 FROM x WHERE fit IS NOT NULL GROUP BY 1, 2
  HAVING count(fit) >= CASE WHEN grp = 'FINANCIAL' OR grp LIKE 'KSIC-64%' OR grp LIKE 'KSIC-65%' OR grp LIKE 'KSIC-66%' THEN 8 ELSE 20 END)"""


@query(METRICS_SQL + ' SELECT grp AS "group", metric, n, round(p1, 6) AS p10, round(p2, 6) AS p25, round(p3, 6) AS p50, round(p4, 6) AS p75, round(p5, 6) AS p90 FROM p')
def calibration_profiles(spark: SparkSession, d: str) -> DataFrame:
    found = Q.calibrated(panel(spark, d), 20, 8)
    return found.select("group", "metric", "n", *(F.round(F.col("profile")[i], 6).alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))))


def _interpolated(high: bool) -> str:
    scores = [0, 25, 50, 75, 100] if high else [100, 75, 50, 25, 0]
    cases = " ".join(f"WHEN value <= p{i + 1} THEN CASE WHEN p{i + 1} = p{i} THEN {scores[i]} ELSE {scores[i - 1]} + (value - p{i}) / (p{i + 1} - p{i}) * {scores[i] - scores[i - 1]} END" for i in range(1, 5))
    return f"CASE WHEN value <= p1 THEN {scores[0]} {cases} ELSE {scores[4]} END"


def _knots(value: str, knots) -> str:
    """piecewise() in SQL."""
    cases = " ".join(f"WHEN {value} <= {x1!r} THEN {y0!r} + ({value} - {x0!r}) / {x1 - x0!r} * {y1 - y0!r}" for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False))
    return f"CASE WHEN {value} IS NULL THEN NULL WHEN {value} <= {knots[0][0]!r} THEN {knots[0][1]!r} {cases} ELSE {knots[-1][1]!r} END"


#: From modules m1 to m5 of t, with e1 and early, to the scores' rows.
MODULES_SQL = exactly("""
v AS (SELECT corp, round_even(m1, 1) AS m1, round_even(m2, 1) AS m2, CASE WHEN e1 <= 0 THEN 0 ELSE round_even(m3, 1) END AS m3, round_even(m4, 1) AS m4,
  CASE WHEN e1 IS NOT NULL AND early IS NOT NULL AND (e1 <= 0 OR early <= 0) THEN 0 ELSE round_even(m5, 1) END AS m5 FROM t),
f AS (SELECT *, round_even(list_avg(list_filter([m1, m2, m3, m4, m5], lambda z: z IS NOT NULL)), 1) AS total FROM v)
SELECT corp, m1, m2, m3, m4, m5, total, CASE WHEN total IS NULL THEN NULL WHEN total >= 75 THEN 'A' WHEN total >= 60 THEN 'B' WHEN total >= 50 THEN 'C' WHEN total >= 25 THEN 'D' ELSE 'F' END AS grade,
  array_to_string(list_filter([CASE WHEN m1 IS NULL THEN 'm1' END, CASE WHEN m2 IS NULL THEN 'm2' END, CASE WHEN m3 IS NULL THEN 'm3' END, CASE WHEN m4 IS NULL THEN 'm4' END, CASE WHEN m5 IS NULL THEN 'm5' END], lambda z: z IS NOT NULL), ',') AS excluded FROM f""")


@query(METRICS_SQL + f""", s AS (SELECT corp, x.metric, {rounded_sql(f"min_by(CASE WHEN x.metric IN ('margin', 'equity_growth') THEN {_interpolated(True)} ELSE {_interpolated(False)} END, pos)", 1)} AS score
  FROM x JOIN p ON p.grp = x.grp AND p.metric = x.metric WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT m.corp, any_value(e1) AS e1, any_value(early) AS early, any_value({_knots("cash_ratio", Q.CASH_KNOTS)}) AS m1, max(score) FILTER (WHERE metric = 'receivable_gap') AS m2, max(score) FILTER (WHERE metric = 'leverage') AS m3,
  max(score) FILTER (WHERE metric = 'margin') * 0.7 + max(score) FILTER (WHERE metric = 'margin_range') * 0.3 AS m4, max(score) FILTER (WHERE metric = 'equity_growth') AS m5
  FROM m LEFT JOIN s ON s.corp = m.corp GROUP BY m.corp),""" + MODULES_SQL)
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    firms = panel(spark, d)
    return Q.quality_scores(firms, Q.calibrated(firms, 20, 8))


def _bucket_case(value: str, bucket: str, table: dict, default: str, scores, first=()) -> str:
    of = lambda name: _knots(value, [*first, *zip(table[name], scores, strict=True)])
    return "CASE " + " ".join(f"WHEN {bucket} = '{name}' THEN {of(name)}" for name in table if name != default) + f" ELSE {of(default)} END"


#: A rule table of the firms' buckets by name, for some of them.
BUCKETS_SQL = "SELECT s_name || ['금융지주', '증권', '카드', '투자', '리츠', ''][CAST(s_suppkey % 6 AS INTEGER) + 1] AS name, ['retail', 'construction', 'bank', 'chemicals'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS lb, ['retail', 'biotech', 'bank', 'utility'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS mb, ['stable', 'cyclic', 'fin_stable', 'general'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS rb FROM supplier WHERE s_suppkey % 5 <> 0"


@query(METRICS_SQL + f""", k AS ({BUCKETS_SQL}), o AS (SELECT DISTINCT corp, name FROM panel), q AS (SELECT m.*, lb, mb, rb FROM m JOIN o USING (corp) LEFT JOIN k USING (name)),
t AS (SELECT corp, e1, early, {_knots("cash_ratio", Q.CASH_KNOTS)} AS m1, {_knots("receivable_gap", Q.GAP_KNOTS)} AS m2, {_bucket_case("leverage", "lb", Q.LEVERAGE_BOUNDS, "manufacturing", Q.LEVERAGE_SCORES, ((0.0, 100.0),))} AS m3,
  {_bucket_case("margin", "mb", Q.MARGIN_BOUNDS, "manufacturing", Q.MARGIN_SCORES)} * 0.7 + {_bucket_case("margin_range", "rb", Q.RANGE_BOUNDS, "general", Q.RANGE_SCORES)} * 0.3 AS m4, {_knots("equity_growth", Q.GROWTH_KNOTS)} AS m5 FROM q),""" + MODULES_SQL)
def absolute_scores(spark: SparkSession, d: str) -> DataFrame:
    held = firms(spark, d)
    kinds = (("retail", "retail", "stable"), ("construction", "biotech", "cyclic"), ("bank", "bank", "fin_stable"), ("chemicals", "utility", "general"))
    of = lambda i: F.get(F.lit([k[i] for k in kinds]), (F.col("corp") % 4).cast("int"))
    book = held.where("corp % 5 <> 0").select("name", of(0).alias("leverage_bucket"), of(1).alias("margin_bucket"), of(2).alias("range_bucket"))
    return Q.absolute_scores(panel(spark, d), Q.with_buckets(held.select("corp", "name"), book))


_KIND = "CASE WHEN name LIKE '%금융지주%' THEN 'bank_holding' WHEN code LIKE '641%' OR code LIKE '642%' THEN 'bank' WHEN code LIKE '65%' THEN 'insurance' WHEN code LIKE '661%' OR name LIKE '%증권%' THEN 'securities' WHEN name LIKE '%카드%' THEN 'card' WHEN name LIKE '%투자%' THEN 'capital_investment' WHEN name LIKE '%리츠%' THEN 'reit' WHEN code LIKE '66%' THEN 'financial_service' ELSE 'other_financial' END"


@query(f"""
WITH panel AS (SELECT *, industry_code AS code, round(net_income / 1000000, 4) AS dps FROM ({PANEL_SQL}) WHERE regexp_matches(industry_code, '^(641|642|65|661|662)')),
y AS (SELECT *, net_income / nullif(total_equity, 0) AS q, net_income / nullif(operating_income, 0) AS i, CASE WHEN revenue > 0 THEN dps / (revenue / 10000000) ELSE 0 END AS dy, row_number() OVER (PARTITION BY corp ORDER BY year DESC) AS b FROM panel),
r AS (SELECT corp, metric, sum(v * w) / sum(w) AS v FROM (SELECT corp, metric, v, least(3, count(*) OVER (PARTITION BY corp, metric)) - row_number() OVER (PARTITION BY corp, metric ORDER BY year DESC) + 1 AS w FROM (UNPIVOT (SELECT corp, year, q AS roe, i AS income, dy AS dividend_yield FROM y) ON roe, income, dividend_yield INTO NAME metric VALUE v)) WHERE w >= 1 GROUP BY 1, 2),
g AS (SELECT corp, 'growth' AS metric, CASE WHEN count(*) >= 3 AND min_by(total_equity, year) > 0 AND max_by(total_equity, year) > 0 THEN pow(max_by(total_equity, year) / min_by(total_equity, year), 1.0 / (max(year) - min(year))) - 1 END AS v FROM y WHERE b <= 3 GROUP BY 1),
l AS (SELECT corp, {_KIND} AS kind, total_equity / nullif(total_assets, 0) AS capital FROM y WHERE b = 1),
u AS (SELECT corp, kind, metric, v FROM (SELECT * FROM r UNION ALL SELECT * FROM g UNION ALL SELECT corp, 'capital', capital FROM l) JOIN l USING (corp) WHERE v IS NOT NULL),
e AS (SELECT *, unnest([kind, CASE WHEN metric = 'capital' AND kind IN ('bank_holding', 'bank') THEN 'banks' END, 'all']) AS grp FROM u),
p AS (SELECT grp, metric, quantile_cont(v, 0.1) AS p1, quantile_cont(v, 0.25) AS p2, quantile_cont(v, 0.5) AS p3, quantile_cont(v, 0.75) AS p4, quantile_cont(v, 0.9) AS p5 FROM e WHERE grp IS NOT NULL GROUP BY 1, 2
  HAVING count(*) >= CASE WHEN grp IN ('all', 'banks') OR (grp = 'bank_holding' AND metric = 'capital') THEN 5 ELSE 20 END),
w AS (SELECT corp, metric, v AS value, unnest(CASE WHEN metric = 'capital' AND kind = 'bank_holding' THEN ['bank_holding', 'banks'] ELSE [kind, 'all'] END) AS grp, unnest([0, 1]) AS pos FROM u),
s AS (SELECT corp, metric, {rounded_sql(f"min_by({_interpolated(True)}, pos)", 1)} AS score FROM w JOIN p USING (grp, metric) GROUP BY 1, 2),
d AS (SELECT corp, greatest(dps, 0) AS dps, year, lag(greatest(dps, 0)) OVER (PARTITION BY corp ORDER BY year) AS d0 FROM y WHERE b <= 3),
c AS (SELECT corp, CASE WHEN count(*) FILTER (WHERE dps > 0) = 0 THEN 0 ELSE greatest(0, least(100, CASE count(*) FILTER (WHERE dps > 0) WHEN 3 THEN 75 WHEN 2 THEN 60 ELSE 35 END - 20 * count(*) FILTER (WHERE d0 > 0 AND dps < d0 * 0.9) + 7.5 * count(*) FILTER (WHERE dps > d0 * 1.05) + CASE WHEN min(dps) > 0 AND count(*) FILTER (WHERE d0 > 0 AND dps < d0 * 0.9) = 0 THEN 10 ELSE 0 END)) END AS dc FROM d GROUP BY 1),
f AS (SELECT l.corp, any_value(kind) AS kind, any_value(dc) AS dc, max(score) FILTER (WHERE metric = 'dividend_yield') AS fy, max(score) FILTER (WHERE metric = 'roe') AS f2, max(score) FILTER (WHERE metric = 'capital') AS f3, max(score) FILTER (WHERE metric = 'income') AS f4, max(score) FILTER (WHERE metric = 'growth') AS f5 FROM l LEFT JOIN s ON s.corp = l.corp LEFT JOIN c ON c.corp = l.corp GROUP BY 1),
z AS (SELECT *, {rounded_sql("coalesce(fy * 0.7 + CAST(dc AS DOUBLE) * 0.3, fy, dc)", 1)} AS f1 FROM f), t AS (SELECT *, {rounded_sql("list_avg(list_filter([f1, f2, f3, f4, f5], lambda z: z IS NOT NULL))", 1)} AS total FROM z)
SELECT corp, kind, CAST(f1 AS DOUBLE) AS f1, f2, f3, f4, f5, total, CASE WHEN total IS NULL THEN NULL WHEN total >= 75 THEN 'A' WHEN total >= 60 THEN 'B' WHEN total >= 50 THEN 'C' WHEN total >= 25 THEN 'D' ELSE 'F' END AS grade,
  array_to_string(list_filter([CASE WHEN f1 IS NULL THEN 'f1' END, CASE WHEN f2 IS NULL THEN 'f2' END, CASE WHEN f3 IS NULL THEN 'f3' END, CASE WHEN f4 IS NULL THEN 'f4' END, CASE WHEN f5 IS NULL THEN 'f5' END], lambda z: z IS NOT NULL), ',') AS missing FROM t""")
def financial_scores(spark: SparkSession, d: str) -> DataFrame:
    held = panel(spark, d).where(I.financial_firm("industry_code", "name"))
    dps = F.round(F.col("net_income") / 1000000, 4)
    yields = held.select("corp", "year", dps.alias("dps"), F.when(F.col("revenue") > 0, dps / (F.col("revenue") / 10000000)).otherwise(0.0).alias("dividend_yield"))
    return B.financial_scores(B.financial_inputs(held, yields))


@query(f"""
WITH panel AS ({PANEL_SQL}), w AS (SELECT *, lag(receivable) OVER o AS r0, lag(revenue) OVER o AS v0, lag(total_liabilities) OVER o AS l0, lag(total_equity) OVER o AS e0, lag(operating_income) OVER o AS o0, row_number() OVER (PARTITION BY corp ORDER BY year DESC) AS b FROM panel WINDOW o AS (PARTITION BY corp ORDER BY year)),
h AS (SELECT corp, list_filter([CASE WHEN total_equity < 0 THEN 'negative_equity' END, CASE WHEN operating_income < 0 THEN 'operating_loss' END, CASE WHEN net_income > 0 AND operating_cashflow / net_income < 0.3 THEN 'cash_gap' END,
  CASE WHEN receivable <> 0 AND revenue <> 0 AND (receivable - r0) / nullif(r0, 0) - (revenue - v0) / nullif(v0, 0) >= 0.15 THEN 'receivable_gap' END, CASE WHEN total_liabilities <> 0 AND (total_liabilities - l0) / nullif(l0, 0) >= 0.30 THEN 'debt_jump' END,
  CASE WHEN o0 / nullif(v0, 0) - operating_income / nullif(revenue, 0) >= 0.05 THEN 'margin_drop' END, CASE WHEN total_liabilities / nullif(total_assets, 0) >= 0.70 THEN 'leverage' END,
  CASE WHEN net_income > 0 AND operating_cashflow / net_income >= 1.2 THEN 'strong_cash' END], lambda z: z IS NOT NULL) AS l FROM w WHERE b = 1)
SELECT corp, coalesce(array_to_string(l[1:3], ','), '') AS highlights FROM h""")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    return Q.highlights(panel(spark, d))


@query(f"""
WITH panel AS ({PANEL_SQL}), y AS (SELECT corp, year, greatest(round(net_income / 1000000, 4), 0) AS dps, row_number() OVER (PARTITION BY corp ORDER BY year DESC) AS b FROM panel), d AS (SELECT *, lag(dps) OVER (PARTITION BY corp ORDER BY year) AS d0 FROM y WHERE b <= 3),
a AS (SELECT corp, count(*) AS n, count(*) FILTER (WHERE dps > 0) AS paid, count(*) FILTER (WHERE d0 > 0 AND dps < d0 * 0.9) AS cuts, count(*) FILTER (WHERE dps > d0 * 1.05) AS rises FROM d GROUP BY 1)
SELECT corp, CAST(CASE WHEN paid > 0 THEN greatest(0, least(100, CASE WHEN paid >= 3 THEN 75 WHEN paid = 2 THEN 60 ELSE 35 END - 20 * cuts + 7.5 * rises + CASE WHEN paid = n AND cuts = 0 THEN 10 ELSE 0 END)) ELSE 0 END AS DOUBLE) AS continuity FROM a""")
def dividend_continuity(spark: SparkSession, d: str) -> DataFrame:
    yearly = panel(spark, d).select("corp", "year", F.round(F.col("net_income") / 1000000, 4).alias("dps"))
    return Q.dividend_score(yearly, "corp", "year", "dps")


@query(f"""
WITH panel AS ({PANEL_SQL}), s AS (SELECT corp, year, CASE WHEN operating_cashflow > 0 THEN '+' ELSE '-' END || CASE WHEN operating_income > 0 THEN '+' ELSE '-' END || CASE WHEN net_income > 0 THEN '+' ELSE '-' END AS g FROM panel)
SELECT corp, string_agg(CASE g WHEN '+-+' THEN 'expanding' WHEN '+--' THEN 'mature' WHEN '++-' THEN 'restructuring' WHEN '+++' THEN 'hoarding' WHEN '--+' THEN 'starting' WHEN '-++' THEN 'distressed' WHEN '-+-' THEN 'shrinking' ELSE 'draining' END, '>' ORDER BY year) AS path FROM s GROUP BY 1""")
def cashflow_paths(spark: SparkSession, d: str) -> DataFrame:
    kinds = panel(spark, d).select("corp", F.struct("year", S.regime(F.col("operating_cashflow"), F.col("operating_income"), F.col("net_income")).alias("g")).alias("s"))
    return kinds.groupBy("corp").agg(F.sort_array(F.collect_list("s")).alias("l")).select("corp", F.array_join(F.col("l.g"), ">").alias("path"))


@query(f"""
WITH e AS ({EDGES_SQL}), c AS (SELECT *, CASE WHEN share > 50 THEN 'subsidiary' WHEN share >= 20 THEN 'associate' WHEN share >= 5 THEN 'investment' END AS relation FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY year DESC, share DESC) AS rn, max(year) OVER (PARTITION BY dst) AS newest FROM c)
SELECT src, dst, year, relation, round(share, 6) AS share FROM l WHERE rn = 1 AND relation IS NOT NULL AND (src % 10 = 0 OR year = newest)""")
def current_relations(spark: SparkSession, d: str) -> DataFrame:
    held = R.classified(edges(spark, d), "share").withColumn("lineage", F.lit("orders"))
    now = R.current(held, F.col("dst"), "lineage", "year", ["src", "dst"], "share", "src", F.col("src") % 10 == 0)
    return now.select("src", "dst", "year", "relation", F.round("share", 6).alias("share"))


@query(f"""
WITH e AS ({EDGES_SQL}), k AS (SELECT *, CASE CAST(src % 4 AS INTEGER) WHEN 0 THEN 'note' WHEN 1 THEN 'contract' WHEN 2 THEN 'prose' ELSE 'api' END AS kind, CASE WHEN dst % 2 = 0 THEN make_date(year + 2, 6, 30) END AS until, CASE WHEN dst % 3 = 0 THEN 'customer' ELSE 'supply' END AS t FROM e),
s AS (SELECT *, max(CASE WHEN kind = 'note' THEN year END) OVER (PARTITION BY CASE WHEN t = 'customer' THEN src ELSE dst END) AS newest FROM k WHERE (src + dst + year) % 7 <> 0)
SELECT src, dst, year FROM s WHERE CASE kind WHEN 'note' THEN year = newest WHEN 'contract' THEN CASE WHEN until IS NOT NULL THEN until >= DATE '2000-03-01' ELSE year >= 1999 END WHEN 'prose' THEN year >= 1999 ELSE true END""")
def fresh_relations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("src") % 4 == 0, "note").when(F.col("src") % 4 == 1, "contract").when(F.col("src") % 4 == 2, "prose").otherwise("api")
    held = edges(spark, d).select("src", "dst", "year", kind.alias("source_kind"), F.when(F.col("dst") % 2 == 0, F.make_date(F.col("year") + 2, F.lit(6), F.lit(30))).alias("valid_until"), F.when(F.col("dst") % 3 == 0, "customer").otherwise("supply").alias("edge_type"), F.when((F.col("src") + F.col("dst") + F.col("year")) % 7 == 0, "terminated").otherwise("active").alias("status"))
    return R.fresh(held, F.lit("2000-03-01").cast("date")).select("src", "dst", "year")


@query("""
WITH h AS (SELECT s_nationkey, s_suppkey AS hub FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) rn FROM supplier) WHERE rn = 1)
SELECT s.s_nationkey, hub, s_suppkey AS member FROM supplier s JOIN h ON h.s_nationkey = s.s_nationkey WHERE s_suppkey <> hub""")
def group_stars(spark: SparkSession, d: str) -> DataFrame:
    return R.stars(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal")


@query(f"""
WITH e AS (SELECT src, dst + 1000000 AS dst, share FROM ({EDGES_SQL})), b AS (SELECT src AS node, dst AS other, 'out' AS direction, share FROM e UNION ALL SELECT dst, src, 'in', share FROM e),
g AS (SELECT node, other, direction, max(share) AS share FROM b GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY share DESC, other, direction) AS i FROM g)
SELECT node, count(*) AS degree, string_agg(other || ':' || direction, ',' ORDER BY i) FILTER (WHERE i <= 5) AS neighbours FROM r GROUP BY 1""")
def ego_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = R.ego_documents(edges(spark, d).withColumn("dst", F.col("dst") + 1000000), "src", "dst", "share", 5)
    return docs.select("node", "degree", F.array_join(F.transform("neighbours", lambda n: F.concat(n["other"].cast("string"), F.lit(":"), n["direction"])), ",").alias("neighbours"))


@query("""
WITH e AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
u AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY n DESC, a) AS rn FROM e), x AS (SELECT 1 AS a, 2 AS b)
SELECT u.a, u.b, n FROM u WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM x WHERE (x.a = u.a AND x.b = u.b) OR (x.a = u.b AND x.b = u.a))""")
def undirected_trade(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = lines.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count("*").alias("n"))
    once = K.undirected(pairs, "a", "b", [], [F.desc("n"), F.col("a")])
    return K.neither_way(once, spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b")), "a", "b")


@query("""
WITH n AS (SELECT c_custkey, 'supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name FROM customer)
SELECT c_custkey, s_suppkey AS code FROM n LEFT JOIN supplier ON lower(s_name) = name""")
def linked_names(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select("c_custkey", X.normal_name(F.concat(F.lit("(주) Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" Co., Ltd."))).alias("name"))
    book = table(spark, d, "supplier").select(X.normal_name("s_name").alias("name"), F.col("s_suppkey").alias("code"))
    return R.linked(asked.withColumnRenamed("name", "asked"), "asked", [book, book.where("code < 0")]).select("c_custkey", "code")


@query("""
WITH n AS (SELECT substr(c_name, 1, 17) AS surface, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))
SELECT surface, count(*) AS freq, min(c_name) AS sample FROM n GROUP BY 1""")
def unlinked_queue(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "customer").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("code")), F.col("c_custkey") == F.col("code"), "left")
    return R.unlinked(links.select(F.substring("c_name", 1, 17).alias("surface"), "c_name", "code"), "surface", "c_name")


#: The items of a line, as accounts, with their order of preference.
ACCOUNTS_SQL = """
SELECT l_suppkey AS firm, year(l_shipdate) AS year, key, account, rank, CAST(sum(v) AS DOUBLE) / 100 AS amount FROM (
  SELECT *, 'price' AS key, 'list' AS account, 1 AS rank, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT *, 'price', 'gross', 2, CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem
  UNION ALL SELECT *, 'volume', 'units', 1, CAST(round(l_quantity * 100) AS BIGINT) FROM lineitem) GROUP BY ALL"""


def accounts(spark: SparkSession, d: str) -> DataFrame:
    line, price, units = table(spark, d, "lineitem"), cents("l_extendedprice"), cents("l_quantity")
    item = lambda key, account, rank, v: F.struct(F.lit(key).alias("key"), F.lit(account).alias("account"), F.lit(rank).alias("rank"), v.alias("v"))
    items = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", item("price", "list", 1, price)), item("price", "gross", 2, price), item("volume", "units", 1, units)))
    each = line.select(F.col("l_suppkey").alias("firm"), F.year("l_shipdate").alias("year"), F.inline(items))
    return each.groupBy("firm", "year", "key", "account", "rank").agg((F.sum("v") / 100.0).alias("amount"))


YEARS = (1996, 1997, 1998, 1999, 2000)


@query(f"""
WITH a AS ({ACCOUNTS_SQL}), f AS (SELECT firm, key, account, min(rank) AS rank, list(amount ORDER BY year) AS l FROM a WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3 HAVING count(DISTINCT year) = 5),
r AS (SELECT *, row_number() OVER (PARTITION BY firm, key ORDER BY rank, account) AS rn FROM f) SELECT firm, key, account, round(l[1], 2) AS first, round(l[5], 2) AS last FROM r WHERE rn = 1""")
def five_year_series(spark: SparkSession, d: str) -> DataFrame:
    found = S.complete_series(accounts(spark, d), "firm", "key", "account", "rank", "year", "amount", YEARS)
    return found.select("firm", "key", "account", F.round(F.col("values")[0], 2).alias("first"), F.round(F.col("values")[4], 2).alias("last"))


@query(f"""
WITH a AS ({ACCOUNTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY firm, year, key ORDER BY rank, abs(amount) DESC) AS rn FROM a)
SELECT firm, year, round(max(CASE WHEN key = 'price' THEN amount END), 2) AS price, round(max(CASE WHEN key = 'volume' THEN amount END), 2) AS volume FROM r WHERE rn = 1 GROUP BY 1, 2""")
def merged_accounts(spark: SparkSession, d: str) -> DataFrame:
    best = S.merged_by_year(accounts(spark, d), ["firm", "year", "key"], "rank", "amount")
    return S.wide(best, ["firm", "year"], "key", "amount", ["price", "volume"]).select("firm", "year", F.round("price", 2).alias("price"), F.round("volume", 2).alias("volume"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'CFS' ELSE 'OFS' END AS dv, CAST(l_quantity AS INTEGER) % 3 AS c, l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE dv WHEN 'CFS' THEN 0 ELSE 1 END, c, CASE WHEN l_extendedprice = 0 THEN 1 ELSE 0 END, l_extendedprice DESC) AS rn FROM i)
SELECT l_orderkey, dv AS division, l_extendedprice AS amount FROM r WHERE rn = 1""")
def preferred_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "CFS").otherwise("OFS").alias("division"), (F.col("l_quantity").cast("int") % 3).alias("c"), F.lit(0).alias("k"), F.col("l_extendedprice").alias("amount"))
    return S.preferred(items, ["l_orderkey"], "division", "c", "k", "amount").select("l_orderkey", "division", "amount")


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS t, CASE CAST(l_partkey % 6 AS INTEGER) WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice * 1000 WHEN 2 THEN -l_extendedprice WHEN 3 THEN l_extendedprice * 1.0005 WHEN 4 THEN l_extendedprice * 1.03 END AS p FROM lineitem)
SELECT CASE WHEN p IS NULL THEN 'missing' WHEN t = p THEN 'exact' WHEN t = 0 OR p = 0 THEN 'zero' WHEN abs(p / t - 1e3) < 1e-3 OR abs(p / t - 1e-3) < 1e-9 OR abs(p / t - 1e6) < 1 OR abs(p / t - 1e-6) < 1e-12 THEN 'unit' WHEN abs(p / t + 1) < 1e-9 THEN 'sign'
  WHEN abs(p - t) / greatest(abs(t), 1) < 0.001 THEN 'near' WHEN abs(p - t) / greatest(abs(t), 1) < 0.05 THEN 'off' ELSE 'wrong' END AS verdict, count(*) AS n FROM (SELECT round_even(t, 0) AS t, round_even(p, 0) AS p FROM v) GROUP BY 1""")
def parse_verdicts(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.col("l_extendedprice"), F.col("l_partkey") % 6
    p = F.when(k == 0, t).when(k == 1, t * 1000).when(k == 2, -t).when(k == 3, t * 1.0005).when(k == 4, t * 1.03)
    return table(spark, d, "lineitem").groupBy(N.parsed_verdict(t, p).alias("verdict")).agg(F.count("*").alias("n"))


SPLIT_SQL = r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]\s+|\n{2,})', '\1' || chr(1), 'g'), chr(1)), lambda z: length(z) > 0) AS s FROM documents),
f AS (SELECT doc_id, s, list_transform(s, lambda z: regexp_matches(z, '[0-9]')) AS f FROM s)"""


@query(SPLIT_SQL + " SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(len(list_filter(f, lambda z: z)) AS INTEGER) AS candidates FROM f")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    split = table(spark, d, "documents").select("doc_id", C.sentences("text").alias("s"))
    return split.select("doc_id", F.size("s").alias("sentences"), F.size(F.filter("s", lambda x: x.rlike("[0-9]"))).alias("candidates"))


@query(SPLIT_SQL + """, h AS (SELECT doc_id, len(s) AS n, unnest(list_filter(range(len(s)), lambda i: f[i + 1])) AS i FROM f), w AS (SELECT doc_id, i, greatest(i - 2, 0) AS a, least(i + 2, n - 1) AS b FROM h),
g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM w),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT doc_id, CAST(min(a) AS INTEGER) AS first, CAST(max(b) AS INTEGER) AS last FROM k GROUP BY doc_id, k""")
def candidate_windows(spark: SparkSession, d: str) -> DataFrame:
    split = table(spark, d, "documents").select("doc_id", C.sentences("text").alias("s")).where(F.size("s") > 0)
    return split.select("doc_id", F.inline(C.windows(F.transform("s", lambda x: x.rlike("[0-9]")))))


@query()
def candidate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.candidate_chunks(table(spark, d, "documents"), "doc_id", "text", "[0-9]")


@query("""
WITH t AS (SELECT doc_id FROM labels WHERE quality = 0), f AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars < 400), n AS (SELECT (SELECT count(*) FROM t JOIN f USING (doc_id)) AS tp, (SELECT count(*) FROM f ANTI JOIN t USING (doc_id)) AS fp, (SELECT count(*) FROM t ANTI JOIN f USING (doc_id)) AS fn)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM n""")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "labels")
    short = table(spark, d, "documents").where("n_chars < 400").join(held, "doc_id").select("doc_id")
    return V.micro_scores(held.where("quality = 0").select("doc_id"), short)


@query("SELECT quality AS expected, CASE WHEN n_chars < 400 THEN 0 ELSE 1 END AS given, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 400, 0).otherwise(1).alias("quality"))
    return V.confusion(table(spark, d, "labels"), given, ["doc_id"], "quality")


@query("""
WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CAST('0x' || substr(md5('s1:' || c_custkey), 1, 8) AS BIGINT), c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_mktsegment, c_custkey FROM r WHERE i <= greatest(1, floor(n * 0.05))""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.stratified(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 0.05, "s1").select("c_mktsegment", "c_custkey")


@query("""
WITH t AS (SELECT doc_id, doc_id % 97 AS c FROM labels WHERE quality = 0), f AS (SELECT doc_id, doc_id % 97 AS c FROM documents JOIN labels USING (doc_id) WHERE n_chars < 400),
p AS (SELECT coalesce(t.c, f.c) AS c, count(*) FILTER (WHERE t.c IS NOT NULL AND f.c IS NOT NULL) AS tp, count(*) FILTER (WHERE t.c IS NULL) AS fp, count(*) FILTER (WHERE f.c IS NULL) AS fn FROM t FULL JOIN f ON t.doc_id = f.doc_id GROUP BY 1),
e AS (SELECT *, unnest(range(1001)) AS b FROM p), u AS (SELECT *, CAST('0x' || substr(md5('b1:' || b || ':' || c), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM e),
k AS (SELECT *, CASE WHEN b = 0 THEN 1 WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 WHEN u < 0.99940582 THEN 5 ELSE 6 END AS k FROM u),
s AS (SELECT b, coalesce(2.0 * sum(k * tp) / nullif(2 * sum(k * tp) + sum(k * fp) + sum(k * fn), 0), 0) AS f1 FROM k GROUP BY 1), l AS (SELECT list(f1 ORDER BY f1) AS l FROM s WHERE b > 0)
SELECT round((SELECT f1 FROM s WHERE b = 0), 9) AS f1, round(l[26], 9) AS low, round(l[976], 9) AS high FROM l""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    held, chunk = table(spark, d, "labels"), (F.col("doc_id") % 97).alias("c")
    short = table(spark, d, "documents").where("n_chars < 400").join(held, "doc_id").select("doc_id", chunk)
    found = V.bootstrap_f1(held.where("quality = 0").select("doc_id", chunk), short, "c", 1000, "b1")
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query("""
WITH g AS (SELECT DISTINCT l_orderkey AS o, l_suppkey % 7 AS c, l_returnflag AS d, l_linestatus AS s FROM lineitem WHERE l_linenumber % 2 = 1),
p AS (SELECT DISTINCT l_orderkey AS o, l_suppkey % 7 AS c, CASE WHEN l_partkey % 5 = 0 THEN 'A' ELSE l_returnflag END AS d, l_linestatus AS s FROM lineitem),
w AS (SELECT * FROM p ANTI JOIN g USING (o, c, d, s))
SELECT g.d || '/' || g.s AS expected, w.d || '/' || w.s AS given, count(*) AS n FROM w JOIN g USING (o, c) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def direction_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 7).alias("c"), "l_returnflag", F.col("l_linestatus").alias("s"), "l_partkey", "l_linenumber")
    truth = rows.where("l_linenumber % 2 = 1").withColumn("d", F.col("l_returnflag"))
    return V.direction_confusion(truth, rows.withColumn("d", F.when(F.col("l_partkey") % 5 == 0, "A").otherwise(F.col("l_returnflag"))), ["o", "c"], ["d", "s"])


@query("""
WITH v AS (SELECT *, [p_size, NULL, p_retailprice, p_partkey % 9, CASE WHEN p_partkey % 2 = 0 THEN 1.5 END] AS a FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 THEN p_size * 1000.0 * CASE p_partkey % 5 WHEN 0 THEN 1e6 WHEN 1 THEN 1e8 WHEN 2 THEN 1e3 ELSE 1 END END AS issue, CASE WHEN p_partkey % 6 >= 3 THEN CAST(greatest(1, floor(100 - p_size + 0.5)) AS INTEGER) END AS top,
  p_size < 1 OR CASE WHEN p_size > 1 THEN p_size / 100.0 ELSE p_size END < 0.01 AS small, list_filter(a, lambda z: z IS NOT NULL)[-1] AS last, CASE WHEN len(list_filter(a, lambda z: z IS NOT NULL)) >= 3 THEN CAST(list_position(a, list_min(a)) - 1 AS INTEGER) END AS valley,
  CASE WHEN p_partkey % 5 <> 4 THEN """ + rounded_sql("p_size * 1000.0 / p_retailprice * 100", 4) + """ END AS dilution, round((p_retailprice - p_size) / p_retailprice * 100, 6) AS gross FROM v""")
def number_values(spark: SparkSession, d: str) -> DataFrame:
    unit = F.get(F.lit(["백만원", "억원", "천원", "원"]), (F.col("p_partkey") % 5).cast("int"))
    text = F.concat(F.lit("제3자배정 발행 예정 총 금액 : 금 "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" "), unit)
    dbl = lambda c: F.col(c).cast("double")
    values = F.array(dbl("p_size"), F.lit(None).cast("double"), dbl("p_retailprice"), (F.col("p_partkey") % 9).cast("double"), F.when(F.col("p_partkey") % 2 == 0, 1.5))
    return table(spark, d, "part").select(
        "p_partkey", N.issue_amount(text).alias("issue"), N.top_percent("p_size", F.col("p_partkey") % 6).alias("top"), N.immaterial("p_size").alias("small"), N.last_valid(values).alias("last"), N.valley(values).alias("valley"),
        F.when(unit.isNotNull(), N.dilution(F.col("p_size") * 1000.0, "p_retailprice")).alias("dilution"), F.round(N.profitability("p_retailprice", "p_size", "p_size", "p_size", "p_size", "p_size")["gross_margin"], 6).alias("gross"),
    )


@query("""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(p_brand, '[^0-9]', '', 'g') AS code, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS flat,
  CASE WHEN p_size > 25 THEN -p_retailprice ELSE p_retailprice END AS amount, CAST(p_size AS DOUBLE) AS pct, round(CASE WHEN p_size > 1 THEN p_size / 100.0 ELSE p_size END, 4) AS share FROM part""")
def text_values(spark: SparkSession, d: str) -> DataFrame:
    written = F.when(F.col("p_size") > 25, F.concat(F.lit("("), F.format_number("p_retailprice", 2), F.lit(")"))).otherwise(F.format_number("p_retailprice", 2))
    return table(spark, d, "part").select(
        "p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), X.digits("p_brand").alias("code"), X.flat("p_name").alias("flat"),
        N.amount(written).alias("amount"), N.percent(F.concat(F.col("p_size").cast("string"), F.lit(" %"))).alias("pct"), N.share(F.col("p_size").cast("string")).alias("share"),
    )


@query("""
SELECT s_suppkey, 'x_' || substr(sha1(s_nationkey || '|' || lower(s_name)), 1, 12) AS uid FROM supplier""")
def unlisted_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", X.unlisted_uid(F.col("s_nationkey").cast("string"), F.concat(F.col("s_name"), F.lit(" Inc."))).alias("uid"))


@query(f"""
WITH panel AS ({PANEL_SQL}), y AS (SELECT corp, year, revenue, (revenue - lag(revenue, 4) OVER w) / nullif(abs(lag(revenue, 4) OVER w), 0) * 100 AS yoy, first_value(revenue) OVER w AS r0, year - min(year) OVER w AS n FROM panel WINDOW w AS (PARTITION BY corp ORDER BY year))
SELECT corp, year, round(yoy, 4) AS yoy, round(CASE WHEN n > 0 AND r0 > 0 AND revenue > 0 THEN pow(revenue / r0, 1.0 / n) - 1 END, 6) AS cagr FROM y""")
def revenue_growth(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("corp").orderBy("year")
    before = F.lag("revenue", 4).over(w)
    rows = panel(spark, d).select("corp", "year", "revenue", N.ratio(F.col("revenue") - before, F.abs(before), 100.0).alias("yoy"), F.first("revenue").over(w).alias("r0"), (F.col("year") - F.min("year").over(w)).alias("n"))
    return rows.select("corp", "year", F.round("yoy", 4).alias("yoy"), F.round(N.cagr("r0", "revenue", F.col("n")), 6).alias("cagr"))


@query(f"""
WITH panel AS ({PANEL_SQL}), t AS (SELECT corp, sum(revenue) AS cap, sum(net_income) AS income, sum(total_equity) AS equity, sum(total_liabilities) AS debt FROM panel GROUP BY 1)
SELECT corp, round(CASE WHEN income > 0 THEN cap / income END, 4) AS per, round(CASE WHEN equity > 0 THEN cap / equity END, 4) AS pbr, round(CASE WHEN equity > 0 THEN income / equity * 100 END, 4) AS roe, round(abs(cap - (debt + equity)) / nullif(abs(cap), 0), 6) AS gap FROM t""")
def valuations(spark: SparkSession, d: str) -> DataFrame:
    t = panel(spark, d).groupBy("corp").agg(F.sum("revenue").alias("cap"), F.sum("net_income").alias("income"), F.sum("total_equity").alias("equity"), F.sum("total_liabilities").alias("debt"))
    per, pbr, roe = N.valuation("cap", "income", "equity")
    return t.select("corp", F.round(per, 4).alias("per"), F.round(pbr, 4).alias("pbr"), F.round(roe, 4).alias("roe"), F.round(N.balance_gap("cap", "debt", "equity"), 6).alias("gap"))


#: Titles of filings for the parts, by key.
TITLES = (
    "사업보고서 (2023.12)", "임원ㆍ주요주주특정증권등소유상황보고서", "최대주주변동", "주요사항보고서(유상증자결정)", "전환사채권발행결정", "주주총회소집공고", "회사합병결정", "단일판매ㆍ공급계약체결",
    "신규시설투자등", "대표이사변경", "매출액또는손익구조30%변동", "자기주식취득결정", "증권발행실적보고서(회사채)", "신주인수권부사채", "capex 계획", "영업양도결정", "기타 안내", "변동 신고 최대주주등",
)


@query(f"""
WITH p AS (SELECT p_partkey, {list(TITLES)!r}[CAST(p_partkey % {len(TITLES)} AS INTEGER) + 1] AS t FROM part),
k AS (SELECT *, CASE WHEN regexp_matches(t, '사업보고서|분기보고서|반기보고서') THEN '정기보고서' WHEN regexp_matches(t, '임원.{{0,6}}주요주주.{{0,10}}소유상황') THEN '내부자거래' WHEN contains(t, '최대주주') AND contains(t, '변동') THEN '최대주주변동'
  WHEN regexp_matches(t, '유상증자|무상증자') THEN '증자' WHEN contains(t, '전환사채') THEN '전환사채' WHEN contains(t, '신주인수권') THEN 'BW' WHEN regexp_matches(t, '합병|분할') THEN 'M&A/분할' WHEN regexp_matches(t, '영업양수|영업양도') THEN '영업양도'
  WHEN regexp_matches(t, '공급계약|수주계약|계약체결') THEN '계약' WHEN contains(t, '시설투자') OR contains(upper(t), 'CAPEX') THEN 'CAPEX' WHEN regexp_matches(t, '대표이사|사내이사|임원') THEN '임원변동' WHEN regexp_matches(t, '매출액|손익|실적') THEN '실적'
  WHEN contains(t, '자기주식') THEN '자기주식' WHEN regexp_matches(t, '회사채|기업어음') THEN '채권발행' ELSE '기타' END AS kind FROM p)
SELECT p_partkey, kind, regexp_matches(t, '주주총회소집공고|사외이사\\s*선임|보고서\\s*제출|IR\\s*개최|소수주주권.*행사|임원주주특정증권등소유보고서|의결권대리행사권유참고서류') AS noise,
  CASE WHEN regexp_matches(t, '최대주주등소유주식변동신고서|증권발행실적보고서') THEN 'later' WHEN regexp_matches(t, '사업보고서|분기보고서|반기보고서|유상증자|무상증자|전환사채|신주인수권|합병|분할|영업양수|영업양도|매출액.*변동|손익.*변동|실적발표') THEN 'immediate' ELSE 'normal' END AS tier,
  CAST(list_sum(list_transform({list(T.PRIORITY)!r}, lambda w: CAST(contains(t, w) AS INTEGER))) AS INTEGER) AS priority,
  p_partkey % 50 = 0 OR kind NOT IN ('기타', '임원변동', '최대주주변동', '내부자거래') AS shown FROM k""")
def filing_titles(spark: SparkSession, d: str) -> DataFrame:
    titled = table(spark, d, "part").select("p_partkey", F.get(F.lit([*TITLES]), (F.col("p_partkey") % len(TITLES)).cast("int")).alias("t"))
    kinds = titled.withColumn("kind", T.filing_type("t"))
    return kinds.select("p_partkey", "kind", T.is_noise("t").alias("noise"), T.tier("t").alias("tier"), T.priority("t").alias("priority"), T.is_shown("kind", "t", F.col("p_partkey") % 50 == 0).alias("shown"))
