"""Statements: line items picked, pivoted and put together as yearly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import latest_per_key

#: Which column and which accounts of a filing count first.
DIVISION_RANK = (("CFS", 0), ("OFS", 1))


def division_rank(division: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in DIVISION_RANK:
        out = out.when(division == name, rank)
    return out.otherwise(9)


def largest_by_name(items: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """keys and the amount of the largest absolute value, of equal ones the larger."""
    return items.where(F.col(amount).isNotNull()).groupBy(*keys).agg(F.max_by(amount, F.struct(F.abs(F.col(amount)), F.col(amount))).alias(amount))


def preferred(items: DataFrame, keys: Sequence[str], division: str, column: str, rank: str, amount: str) -> DataFrame:
    """One item for each key: consolidated first, then the nearer column, the better match, a number other than 0, then
    the larger."""
    order = [division_rank(F.col(division)), F.col(column), F.col(rank), (F.coalesce(F.col(amount), F.lit(0.0)) == 0).cast("int"), F.col(amount).desc_nulls_last()]
    return latest_per_key(items, keys, order)


def complete_series(items: DataFrame, firm: str, key: str, account: str, rank: str, year: str, amount: str, years: Sequence[int]) -> DataFrame:
    """firm, key, account and values (one for each of years, in order) of the first account by rank that has them all."""
    own = items.where(F.col(year).isin(list(years)) & F.col(amount).isNotNull())
    found = own.groupBy(firm, key, account).agg(F.min(rank).alias("_rank"), F.countDistinct(year).alias("_n"), F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col(year), F.col(amount))))).alias("_m"))
    full = latest_per_key(found.where(F.col("_n") == len(years)), [firm, key], [F.col("_rank"), F.col(account)])
    return full.select(firm, key, account, F.array(*(F.element_at("_m", F.lit(y)) for y in years)).alias("values"))


def merged_by_year(items: DataFrame, keys: Sequence[str], rank: str, amount: str) -> DataFrame:
    """One amount for each key, of the least rank, then the largest absolute value, then the larger."""
    return latest_per_key(items.where(F.col(amount).isNotNull()), keys, [F.col(rank), F.abs(F.col(amount)).desc(), F.col(amount).desc()])


def wide(items: DataFrame, keys: Sequence[str], account: str, amount: str, accounts: Sequence[str]) -> DataFrame:
    """keys with a column for each account: the only amount of it, or the largest."""
    return items.groupBy(*keys).pivot(account, list(accounts)).agg(F.max(amount))


#: The eight regimes of cash flows by the signs of operating, investing and financing.
REGIMES = {
    "+-+": "expanding", "+--": "mature", "++-": "restructuring", "+++": "hoarding", "--+": "starting", "-++": "distressed", "-+-": "shrinking", "---": "draining",
}


def regime(operating: Column, investing: Column, financing: Column) -> Column:
    """The regime of a year's three cash flows; flat if one is 0, null if one is null."""
    sign = lambda v: F.when(v > 0, "+").when(v < 0, "-").when(v == 0, "0")
    signs = F.concat(sign(operating), sign(investing), sign(financing))
    table = F.create_map(*(F.lit(x) for pair in REGIMES.items() for x in pair))
    return F.when(signs.isNotNull(), F.coalesce(F.try_element_at(table, signs), F.lit("flat")))
