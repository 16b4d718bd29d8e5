"""Queries of scans, filters, joins, aggregates, windows and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import texts as X
from ..operators import events as E
from ..operators import keyed as K
from ..operators import peers as P
from .tables import PRICES_SQL, prices, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Knots of an order against a customer's balance.
SPEND_KNOTS = ((0, 0), (10, 50), (50, 80), (100, 100))


@query("""
WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders),
r AS (SELECT c_custkey, o_orderkey, o_totalprice / nullif(c_acctbal, 0) AS ratio FROM customer JOIN l ON o_custkey = c_custkey WHERE rn = 1),
s AS (SELECT *, CASE WHEN ratio IS NULL THEN NULL WHEN ratio <= 0 THEN 0.0 WHEN ratio <= 10 THEN ratio / 10 * 50.0 WHEN ratio <= 50 THEN 50.0 + (ratio - 10) / 40 * 30.0 WHEN ratio <= 100 THEN 80.0 + (ratio - 50) / 50 * 20.0 ELSE 100.0 END AS sc FROM r)
SELECT c_custkey, o_orderkey, round(ratio, 6) AS ratio, round(sc, 6) AS score, CASE WHEN sc IS NULL THEN NULL WHEN sc >= 75 THEN 'A' WHEN sc >= 60 THEN 'B' WHEN sc >= 50 THEN 'C' WHEN sc >= 25 THEN 'D' ELSE 'F' END AS grade FROM s""")
def latest_order_grade(spark: SparkSession, d: str) -> DataFrame:
    last = K.latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    scored = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", N.ratio("o_totalprice", "c_acctbal").alias("r"))
    scored = scored.withColumn("s", N.piecewise("r", SPEND_KNOTS))
    return scored.select("c_custkey", "o_orderkey", F.round("r", 6).alias("ratio"), F.round("s", 6).alias("score"), N.grade("s").alias("grade"))


@query("SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn <= 3")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return K.top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "place").select("o_custkey", "o_orderkey", "place")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_urgent(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return K.absent(table(spark, d, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("""
WITH days AS (SELECT CAST(ts AS DATE) AS day, stddev_samp(value) AS sd FROM events GROUP BY 1), quiet AS (SELECT day FROM days WHERE sd < (SELECT avg(sd) * 0.95 FROM days))
SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) IN (SELECT day FROM quiet)""")
def events_on_quiet_days(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = ev.groupBy("day").agg(F.stddev_samp("value").alias("sd"))
    quiet = days.crossJoin(days.agg((F.avg("sd") * 0.95).alias("bound"))).where("sd < bound").select("day")  # days by one row
    return ev.join(quiet, "day", "left_semi").select("event_id", "event_type")


@query("""
SELECT c_mktsegment, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS cap FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((c_mktsegment, n_name), (c_mktsegment))""")
def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupingSets([["c_mktsegment", "n_name"], ["c_mktsegment"]], "c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("cap"))


@query("""
SELECT p_type, count(*) AS n, median(p_retailprice) AS mid, round(avg(p_size), 6) AS mean_size, CAST(count(*) FILTER (WHERE p_size > 25) AS BIGINT) AS large,
       round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands
FROM part GROUP BY p_type""")
def part_statistics(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("p_retailprice", F.lit([0.1, 0.9]))
    return table(spark, d, "part").groupBy("p_type").agg(
        F.count("*").alias("n"), F.median("p_retailprice").alias("mid"), F.round(F.avg("p_size"), 6).alias("mean_size"), F.count_if(F.col("p_size") > 25).alias("large"),
        F.round(q[0], 6).alias("p10"), F.round(q[1], 6).alias("p90"), F.countDistinct("p_brand").alias("brands"),
    )


@query("""
SELECT c_custkey, CAST(rk AS INTEGER) AS market_rank, CASE WHEN rk <= 50 AND c_acctbal IS NOT NULL THEN 'named' ELSE 'dot' END AS tier
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) rk FROM customer)""")
def market_tiers(spark: SparkSession, d: str) -> DataFrame:
    return P.market_tiers(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", 50).select("c_custkey", "market_rank", "tier")


@query("""
SELECT c_custkey, round(sqrt(i) * cos(i * 2.399963229728653), 6) AS x, round(sqrt(i) * sin(i * 2.399963229728653), 6) AS y
FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS i FROM customer)""")
def sector_spiral(spark: SparkSession, d: str) -> DataFrame:
    return P.spiral(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_custkey").select("c_custkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""
WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, CAST(round_even((n - 1 - i) / (n - 1) * 100, 0) AS INTEGER) AS percentile FROM r""")
def sector_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return P.rank_percentile(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_custkey").select("c_custkey", "percentile")


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal > 9000 THEN 'subsidiary' END AS big, CASE WHEN b > 50 THEN 'subsidiary' WHEN b >= 20 THEN 'associate' WHEN b >= 5 THEN 'investment' END AS class,
       CASE WHEN b < 15 THEN 'low' WHEN b < 25 THEN 'medium' ELSE 'high' END AS volatility, CASE WHEN b - 40 >= 2 THEN 'positive' WHEN b - 40 <= -2 THEN 'negative' ELSE 'neutral' END AS label,
       CASE WHEN s_acctbal * 1e9 >= 5e12 THEN 3 WHEN s_acctbal * 1e9 >= 1e12 THEN 2 WHEN s_acctbal * 1e9 >= 2e11 THEN 1 ELSE 0 END AS bucket,
       CASE WHEN s_acctbal > 0 THEN round(least(sqrt(s_acctbal / 1000.0) * 0.3 + 0.5, 3.5), 6) ELSE 0.5 END AS size, CASE WHEN s_acctbal * 1e9 >= 3e12 THEN '조' ELSE '억' END AS unit
FROM (SELECT *, s_acctbal / 100 AS b FROM supplier)""")
def value_classes(spark: SparkSession, d: str) -> DataFrame:
    b, cap = F.col("s_acctbal") / 100, F.col("s_acctbal") * 1e9
    return table(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") > 9000, "subsidiary").alias("big"), N.ownership(b).alias("class"), N.volatility_class(b).alias("volatility"), N.return_label(b - 40).alias("label"),
        N.cap_bucket(cap).alias("bucket"), F.round(N.scaled_size("s_acctbal", 1000.0), 6).alias("size"), N.display_unit(cap).alias("unit"),
    )


@query(f"""
WITH p AS ({PRICES_SQL})
SELECT user_id, day, round(close / nullif(lag(close) OVER (PARTITION BY user_id ORDER BY day), 0) * 100 - 100, 6) AS change FROM p""")
def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return E.daily_returns(prices(spark, d), "user_id", "day", "close").select("user_id", "day", F.round("change", 6).alias("change"))


STUDY_SQL = f"""
WITH p AS ({PRICES_SQL}), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM p),
e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'),
b AS (SELECT e.user_id, event_id, min(day) AS base_day FROM e JOIN i ON i.user_id = e.user_id AND day > d AND day <= d + INTERVAL 7 DAY GROUP BY 1, 2),
s AS (SELECT b.user_id, event_id, base_day, z.day AS end_day, z.close / nullif(a.close, 0) * 100 - 100 AS change
      FROM b JOIN i a ON a.user_id = b.user_id AND a.day = base_day JOIN i z ON z.user_id = b.user_id AND z.i = a.i + 5)"""


@query(STUDY_SQL + """ SELECT user_id, event_id, base_day, end_day, round(change, 6) AS change, CASE WHEN change >= 2 THEN 'positive' WHEN change <= -2 THEN 'negative' WHEN change IS NOT NULL THEN 'neutral' END AS label FROM s""")
def event_study(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", F.to_date("ts").alias("d"))
    found = E.event_study(asked, prices(spark, d), "user_id", "event_id", "d", "day", "close")
    return found.select("user_id", "event_id", "base_day", "end_day", F.round("change", 6).alias("change"), "label")


@query(STUDY_SQL + """, l AS (SELECT e.event_id, coalesce(CASE WHEN change >= 2 THEN 'positive' WHEN change <= -2 THEN 'negative' WHEN change IS NOT NULL THEN 'neutral' END, 'unlabelled') AS label FROM e LEFT JOIN s USING (event_id))
SELECT coalesce(label, 'total') AS label, count(*) AS n FROM l GROUP BY ROLLUP (label)""")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").where("event_type = 'error'").select("event_id")
    return E.label_counts(asked.join(event_study(spark, d).select("event_id", "label"), "event_id", "left"), "label")


@query(STUDY_SQL + """, q AS (SELECT *, change >= 2 OR change <= -2 AS hit, user_id % 3 = 0 AS quiet FROM s),
u AS (SELECT 'all' AS population, hit FROM q UNION ALL SELECT 'quiet', hit FROM q WHERE quiet)
SELECT population, count(*) AS n, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS decided, round(count(*) FILTER (WHERE hit) / count(*), 4) AS share FROM u GROUP BY 1""")
def label_purity(spark: SparkSession, d: str) -> DataFrame:
    return E.purity(event_study(spark, d), "label", F.col("user_id") % 3 == 0)


@query("""
WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), b AS (SELECT user_id, day FROM e WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) > 3)
SELECT event_id, event_type FROM e WHERE NOT (event_type = 'click' AND EXISTS (SELECT 1 FROM b WHERE b.user_id = e.user_id AND b.day = e.day))""")
def without_bursts(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return E.without_bursts(ev, ["user_id", "day"], F.col("event_type") == "click", 3).select("event_id", "event_type")


#: What parts of a type mean, in the order of the rules.
PART_RULES = (("^STANDARD|PROMO", "earnings"), ("ECONOMY", "debt"), ("SMALL|MEDIUM", "capital"))
ROUTES = {"earnings": "cash,margin", "debt": "leverage", "capital": "growth,equity"}


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^STANDARD|PROMO') THEN 'earnings' WHEN regexp_matches(p_type, 'ECONOMY') THEN 'debt' WHEN regexp_matches(p_type, 'SMALL|MEDIUM') THEN 'capital' ELSE 'other' END AS kind FROM part),
r AS (SELECT kind, unnest(string_split(CASE kind WHEN 'earnings' THEN 'cash,margin' WHEN 'debt' THEN 'leverage' WHEN 'capital' THEN 'growth,equity' ELSE 'none' END, ',')) AS dimension FROM t)
SELECT kind, dimension, count(*) AS n FROM r GROUP BY 1, 2""")
def routed_dimensions(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part").select(X.first_match("p_type", PART_RULES, "other").alias("kind"))
    routed = kinds.select("kind", F.explode(F.split(X.mapped("kind", ROUTES, "none"), ",")).alias("dimension"))
    return routed.groupBy("kind", "dimension").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, rank, CAST(place AS INTEGER) AS place FROM (SELECT o_orderkey, rank, row_number() OVER (ORDER BY rank, o_orderdate DESC, o_orderkey) AS place FROM (
  SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS rank FROM orders WHERE o_orderstatus <> 'F')) WHERE place <= 100""")
def backfill_queue(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    first = table(spark, d, "orders").where("o_orderstatus <> 'F'").withColumn("rank", rank).orderBy("rank", F.desc("o_orderdate"), "o_orderkey").limit(100)  # a queue of 100 is the feature
    return first.select("o_orderkey", "rank", F.row_number().over(Window.orderBy("rank", F.desc("o_orderdate"), "o_orderkey")).alias("place"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'business' WHEN s_suppkey IS NOT NULL THEN 'universe' ELSE 'fallback' END AS origin FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def caps_by_priority(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    first = c.where("c_acctbal > 0").select("c_custkey", F.lit("business").alias("origin"))
    second = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("universe").alias("origin")).join(c.select("c_custkey"), "c_custkey", "left_semi")
    return K.first_by_priority([first, second, c.select("c_custkey", F.lit("fallback").alias("origin"))], ["c_custkey"])


@query("""
WITH o AS (SELECT c_custkey k, c_acctbal v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey k, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END v FROM customer WHERE c_custkey % 4 <> 0)
SELECT k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n USING (k)""")
def table_changes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return K.compared(c.where("k % 3 <> 0"), c.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v"))), ["k"])


@query("""
SELECT r_name, CAST(count(n_nationkey) AS BIGINT) AS nations, coalesce(sum(c), 0)::BIGINT AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"))


@query("""
SELECT (SELECT count(*) FROM customer) >= 100 AS enough, (SELECT count(*) FROM customer WHERE c_name IS NULL) = 0 AS named, (SELECT count(*) FROM customer WHERE c_acctbal IS NULL) = 0 AS capped,
       (SELECT count(*) FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey IS NULL) = 0 AS mapped, (SELECT count(DISTINCT c_custkey) = count(*) FROM customer) AS distinct_keys""")
def registry_gates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    none = lambda cond: F.count_if(cond) == 0
    return c.agg((F.count("*") >= 100).alias("enough"), none(F.col("c_name").isNull()).alias("named"), none(F.col("c_acctbal").isNull()).alias("capped"), none(F.col("n_nationkey").isNull()).alias("mapped"), (F.countDistinct("c_custkey") == F.count("*")).alias("distinct_keys"))


@query("""
SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1""")
def price_regression(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) - INTERVAL 5 DAY = CAST(ts AS DATE) AS never, strftime(ts, '%Y%m%d') AS receipt FROM events""")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("ts")
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), (F.date_sub(day, 5) == day).alias("never"), F.date_format("ts", "yyyyMMdd").alias("receipt"))
