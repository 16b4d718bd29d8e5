"""The library's shapes of tables, derived from the given ones; PANEL_SQL and EDGES_SQL say the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.industries import peer_groups


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(c: str) -> Column:
    """A price in cents or a rate in hundredths, as a whole number: sums of these don't depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


def rounded_sql(x: str, places: int) -> str:
    """numbers.rounded() in DuckDB: to the exact binary value's places."""
    p = f"CAST({10**places} AS DOUBLE)"
    over = f"((floor(y * 1048576.0) / 1048576.0 * 2 * {p} - (2 * floor(y * {p}) + 1)) + (y - floor(y * 1048576.0) / 1048576.0) * 2 * {p})"
    up = f"floor(y * {p}) + CASE WHEN {over} > 0 OR ({over} = 0 AND floor(y * {p}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda v: sign(v) * list_transform([abs(v)], lambda y: ({up}) / {p})[1])[1]"


def exactly(sql: str, places: int = 1) -> str:
    """sql with rounded_sql() for each round_even(x, places)."""
    begin, end = "round_even(", f", {places})"
    while (a := sql.rfind(begin)) >= 0:  # the last has none inside
        b, depth = a + len(begin), 0
        while depth or not sql.startswith(end, b):
            depth += (sql[b] == "(") - (sql[b] == ")")
            b += 1
        sql = sql[:a] + rounded_sql(sql[a + len(begin) : b], places) + sql[b + len(end) :]
    return sql


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each supplier and year of shipping, with measures made of its lines, and its peer groups."""
    price, off, tax = cents("l_extendedprice"), cents("l_discount"), cents("l_tax")
    flag = lambda c, v: (F.col(c) == v).cast("long")
    years = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("corp"), F.year("l_shipdate").alias("year")).agg(
        (F.sum(price * (100 - off)) / 10000.0).alias("revenue"), (F.sum(price * (6 - off)) / 10000.0).alias("operating_income"), (F.sum(price * (tax - 3)) / 10000.0).alias("operating_cashflow"),
        (F.sum(price * (5 - off)) / 10000.0).alias("net_income"), (F.sum(price * flag("l_returnflag", "R")) / 100.0).alias("receivable"),
        (F.sum(cents("l_quantity") * 900 * flag("l_linestatus", "O")) / 100.0).alias("total_liabilities"), (F.sum(price * 3 - cents("l_quantity") * 3300) / 1000.0).alias("total_equity"),
    )
    return years.withColumn("total_assets", F.col("total_liabilities") + F.col("total_equity")).join(firms(spark, folder), "corp")


#: Endings of the suppliers' names, by key.
NAME_ENDS = ("금융지주", "증권", "카드", "투자", "리츠", "")


def firms(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier as a firm: corp, name, an industry code of four digits by nation and key, and its peer groups."""
    code = F.concat((F.col("s_nationkey") % 8 + 60).cast("string"), (F.col("s_suppkey") % 3 + 1).cast("string"), (F.col("s_suppkey") % 2).cast("string"))
    name = F.concat("s_name", F.get(F.lit([*NAME_ENDS]), (F.col("s_suppkey") % len(NAME_ENDS)).cast("int")))
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("corp"), name.alias("name"), code.alias("industry_code"), peer_groups(code).alias("groups"))


PANEL_SQL = """
  SELECT y.*, total_liabilities + total_equity AS total_assets, name, code AS industry_code, 'KSIC-' || left(code, 3) AS g1, 'KSIC-' || left(code, 2) AS g2,
         CASE WHEN left(code, 2) IN ('64', '65', '66') THEN 'FINANCIAL' ELSE 'MARKET' END AS g3
  FROM (
    SELECT l_suppkey AS corp, year(l_shipdate) AS year,
           CAST(sum(p * (100 - d)) AS DOUBLE) / 10000.0 AS revenue, CAST(sum(p * (6 - d)) AS DOUBLE) / 10000.0 AS operating_income,
           CAST(sum(p * (t - 3)) AS DOUBLE) / 10000.0 AS operating_cashflow, CAST(sum(p * (5 - d)) AS DOUBLE) / 10000.0 AS net_income,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN p ELSE 0 END) AS DOUBLE) / 100.0 AS receivable,
           CAST(sum(CASE WHEN l_linestatus = 'O' THEN q * 900 ELSE 0 END) AS DOUBLE) / 100.0 AS total_liabilities,
           CAST(sum(p * 3 - q * 3300) AS DOUBLE) / 1000.0 AS total_equity
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) p, CAST(round(l_discount * 100) AS BIGINT) d,
                 CAST(round(l_tax * 100) AS BIGINT) t, CAST(round(l_quantity * 100) AS BIGINT) q FROM lineitem)
    GROUP BY 1, 2) y
  JOIN (SELECT s_suppkey, s_name || ['금융지주', '증권', '카드', '투자', '리츠', ''][CAST(s_suppkey % 6 AS INTEGER) + 1] AS name,
               CAST(s_nationkey % 8 + 60 AS VARCHAR) || CAST(s_suppkey % 3 + 1 AS VARCHAR) || CAST(s_suppkey % 2 AS VARCHAR) AS code FROM supplier) ON s_suppkey = corp"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """src (a supplier), dst (a customer), year, share: the percent of the customer's year that it spends there."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spent = lines.groupBy(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"), F.year("o_orderdate").alias("year")).agg(F.sum(cents("l_extendedprice")).alias("cents"))
    whole = F.sum("cents").over(Window.partitionBy("dst", "year"))  # lines are joined once, and not summed where no share is asked for
    return spent.select("src", "dst", "year", (F.col("cents") / whole * 100).alias("share"))


EDGES_SQL = """
  SELECT src, dst, year, cents / sum(cents) OVER (PARTITION BY dst, year) * 100 AS share
  FROM (SELECT l_suppkey AS src, o_custkey AS dst, year(o_orderdate) AS year,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """One close for each user and day: the mean value of its events, in whole hundredths."""
    days = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(cents("value")).alias("s"), F.count("*").alias("n"))
    return days.select("user_id", "day", (F.col("s") / F.col("n") / 100.0).alias("close"))


PRICES_SQL = """
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS close
  FROM events GROUP BY 1, 2"""
