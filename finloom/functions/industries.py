"""Industry codes: peer groups, financial firms and their kinds. Codes are strings of digits, other characters don't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

#: The two digits that begin the codes of finance and insurance.
FINANCE = ("64", "65", "66")
#: Words in names of financial firms under code 649, and names of financial holdings.
FINANCE_WORDS = ("금융", "은행", "증권", "보험", "카드", "캐피탈", "인베스트", "벤처", "투자", "스팩", "리츠")
HOLDINGS = ("KB금융", "신한지주", "하나금융지주", "우리금융지주", "메리츠금융지주", "한국금융지주", "JB금융지주", "iM금융지주", "BNK금융지주")


def is_financial(code: Column | str) -> Column:
    """Whether a code is of finance or insurance; null for a null."""
    return F.substring(F.trim(col(code)), 1, 2).isin(*FINANCE)


def is_financial_group(group: Column | str) -> Column:
    """Whether a peer group is one of financial firms."""
    return (col(group) == "FINANCIAL") | F.substring(col(group), 1, 7).isin(*(f"KSIC-{c}" for c in FINANCE))


def peer_groups(code: Column | str) -> Column:
    """The groups of a code's firm, the nearest first: three digits, two digits, and all financial or all other firms.
    Financial firms are never compared with others; a code of fewer digits has fewer groups."""
    digits = F.coalesce(F.regexp_replace(col(code), "[^0-9]", ""), F.lit(""))
    group = lambda n: F.when(F.length(digits) >= n, F.concat(F.lit("KSIC-"), F.substring(digits, 1, n)))
    return F.array_compact(F.array(group(3), group(2), F.when(is_financial(digits), "FINANCIAL").otherwise("MARKET")))


def financial_firm(code: Column | str, name: Column | str) -> Column:
    """Whether a firm is scored as a financial one: by its code, under 649 by its name."""
    c, n = F.coalesce(col(code), F.lit("")), F.coalesce(col(name), F.lit(""))
    return c.rlike("^(641|642|65|661|662)") | (c.startswith("649") & (n.isin(*HOLDINGS) | n.rlike("|".join(FINANCE_WORDS))))


def financial_kind(code: Column | str, name: Column | str) -> Column:
    """The kind of a financial firm, by name and code in a fixed order."""
    c, n = F.coalesce(col(code), F.lit("")), F.coalesce(col(name), F.lit(""))
    out = F.when(n.contains("금융지주") | n.isin(*HOLDINGS), "bank_holding").when(c.rlike("^64[12]"), "bank").when(c.startswith("65"), "insurance")
    out = out.when(c.startswith("661") | n.contains("증권"), "securities").when(n.contains("카드"), "card").when(n.rlike("캐피탈|투자|인베스트|벤처"), "capital_investment")
    return out.when(n.contains("스팩"), "spac").when(n.contains("리츠"), "reit").when(c.startswith("66"), "financial_service").otherwise("other_financial")
