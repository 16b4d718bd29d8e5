"""Scores of financial firms: yearly inputs against the firms of their kind where these are enough, else against all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.industries import financial_kind
from ..functions.numbers import cagr, grade, peer_score, ratio, rounded
from .earnings import dividend_score, mean_of_available
from .peers import profiles, with_profile

#: The metrics that are scored among peers, all better high, the yield's share in the first module and continuity's.
METRICS, YIELD_SHARE, REST = ("dividend_yield", "roe", "capital", "income", "growth"), 0.7, 0.3


def recent_mean(rows: DataFrame, key: str, year: str, value: str, last: int = 3) -> DataFrame:
    """key and value: the mean of the last years that have a value, the oldest of them weighing 1, the next 2, and so on."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(year)))
    held = rows.where(F.col(value).isNotNull()).withColumn("_b", back).where(F.col("_b") <= last)
    n = F.count("*").over(Window.partitionBy(key))
    weighed = held.withColumn("_w", n - F.col("_b") + 1)
    return weighed.groupBy(key).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))


def yearly_yields(dividends: DataFrame, closes: DataFrame, key: str) -> DataFrame:
    """key, year, dps (all dividends of the year) and dividend_yield (dps over the year's last close, 0 where that isn't
    positive), of years with a close. dividends: key, day, amount; closes: key, day, close; null closes don't count."""
    ends = closes.where("close IS NOT NULL").groupBy(key, F.year("day").alias("year")).agg(F.max_by("close", "day").alias("_close"))
    paid = dividends.groupBy(key, F.year("day").alias("year")).agg(F.sum("amount").alias("_paid"))
    dps = F.coalesce(F.col("_paid"), F.lit(0.0))
    return ends.join(paid, [key, "year"], "left").select(key, "year", dps.alias("dps"), F.when(F.col("_close") > 0, dps / F.col("_close")).otherwise(0.0).alias("dividend_yield"))


def financial_inputs(panel: DataFrame, yields: DataFrame) -> DataFrame:
    """corp, kind, dividend_yield, continuity, roe and income (net over operating; recent means), capital (equity over
    assets of the last year) and growth (of equity over the last three years that have it, by the years between).
    panel: corp, name, industry_code, year and measures; yields: corp, year, dps, dividend_yield."""
    rates = panel.select("corp", "year", ratio("net_income", "total_equity").alias("roe"), ratio("net_income", "operating_income").alias("income"))
    back = F.row_number().over(Window.partitionBy("corp").orderBy(F.desc("year")))
    last = panel.withColumn("_b", back).where("_b = 1").select("corp", financial_kind("industry_code", "name").alias("kind"), ratio("total_equity", "total_assets").alias("capital"))
    held = panel.where("total_equity IS NOT NULL").withColumn("_b", back).where("_b <= 3")
    ends = held.groupBy("corp").agg(F.count("*").alias("n"), F.min_by("total_equity", "year").alias("a"), F.max_by("total_equity", "year").alias("z"), (F.max("year") - F.min("year")).alias("years"))
    parts = [
        ends.select("corp", F.when(F.col("n") >= 3, cagr("a", "z", F.col("years"))).alias("growth")), recent_mean(rates, "corp", "year", "roe"), recent_mean(rates, "corp", "year", "income"),
        recent_mean(yields, "corp", "year", "dividend_yield"), dividend_score(yields, "corp", "year", "dps"),
    ]
    for part in parts:
        last = last.join(part, "corp", "left")
    return last


def financial_scores(inputs: DataFrame, fewest_own: int = 20, fewest_all: int = 5) -> DataFrame:
    """corp, kind, f1 to f5, total (the mean of those there are), grade and missing (the others). A metric is scored among
    the kind from fewest_own values on, else among all from fewest_all on; the capital of bank holdings among these from
    fewest_all on, else with banks. f1: YIELD_SHARE of the yield's score and the rest of continuity, or the one there is."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))
    each = inputs.select("corp", "kind", F.inline(pairs))
    capital, holding = F.col("metric") == "capital", F.col("kind") == "bank_holding"
    banks = F.when(capital & F.col("kind").isin("bank_holding", "bank"), "banks")
    fits = profiles(each.withColumn("banks", banks), F.array(F.col("kind"), F.col("banks"), F.lit("all")), "metric", "value", fewest_all)
    own = (F.col("n") >= fewest_own) | F.col("group").isin("all", "banks") | ((F.col("group") == "bank_holding") & capital)
    wanted = F.when(capital & holding, F.array(F.lit("bank_holding"), F.lit("banks"))).otherwise(F.array(F.col("kind"), F.lit("all")))
    rows = with_profile(each, wanted, "metric", fits.where(own), ["corp"])
    score = peer_score("value", F.col("profile"))
    wide = rows.groupBy("corp").agg(*(F.max(F.when(F.col("metric") == m, score)).alias(f"_{m}") for m in METRICS))
    paid = blended(F.col("_dividend_yield"), F.col("continuity"), YIELD_SHARE, REST)
    scored = inputs.select("corp", "kind", "continuity").join(wide, "corp").select("corp", "kind", rounded(paid, 1).alias("f1"), *(F.col(f"_{m}").alias(f"f{i}") for i, m in enumerate(METRICS[1:], 2)))
    names = [f"f{i}" for i in range(1, 6)]
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in names))), ",")
    return scored.withColumn("total", mean_of_available([F.col(n) for n in names])).withColumn("grade", grade("total")).withColumn("missing", missing)


def blended(first: Column, second: Column, share: float = 0.7, rest: float = 0.3) -> Column:
    """share of first and rest of second; whichever there is if one is null. rest is given, as 1 - 0.7 isn't 0.3."""
    return F.coalesce(first * share + second * rest, first, second)
