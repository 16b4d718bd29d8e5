"""Column builders for texts: ordered rules, names, titles and links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def first_match(text: Column | str, rules: Sequence[tuple[str, str]], rest: str | None = None) -> Column:
    """The value of the first rule (pattern, value) whose pattern is found; the order is part of the rules."""
    out = F.when(col(text).isNull(), F.lit(rest).cast("string"))
    for pattern, value in rules:
        out = out.when(col(text).rlike(pattern), value)
    return out.otherwise(F.lit(rest).cast("string"))


def hits(text: Column | str, words: Sequence[str]) -> Column:
    """How many of the words a text contains."""
    total = F.lit(0)
    for w in words:
        total = total + F.coalesce(col(text).contains(w).cast("int"), F.lit(0))
    return total


def mapped(value: Column | str, table: Mapping[str, str], rest: str | None = None) -> Column:
    """table's value for a value, else rest."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in table.items():
        out = out.when(col(value) == k, v)
    return out.otherwise(F.lit(rest).cast("string"))


#: Legal forms at either end of company names, lower-case, and notes that don't belong to a name.
FORMS = ("주식회사", "(주)", "㈜", "co.,ltd.", "co.,ltd", "co.ltd.", "co.ltd", "co.,", "co.", "co", "ltd.", "ltd", "inc.", "inc", "corporation", "corp.", "corp")
NOTES = (r"\(\s*주\s*\d+\s*\)", r"\(\s*\*+\s*[\d,\s]*\)", r"※\s*\d*", r"\(\s*구[,.\s][^)]*\)", r"\(\s*(?:비상장|상장)(?:회사|법인)?\s*\)", r"\(\s*주\s*\d*\s*(?:참조|참고)\s*\)", r"\(\s*(?:보통주|종류주|우선주|의결권\s*없는\s*주식)\s*\)", r"[,\s]*\*+\s*\d*\s*\)?\s*$", r"[,\s]*주\s*[\d,\s]+\s*\)?\s*$", r"^\s*[*※]+\s*")


def normal_name(name: Column | str, aliases: Mapping[str, str] | None = None) -> Column:
    """A company's name for lookups: notes gone, then legal forms at either end until none is left, the longest first;
    lower-case, without blanks or punctuation at the ends; and what aliases has for the result, if anything."""
    forms = "|".join("\\Q" + w + "\\E" for w in sorted(FORMS, key=len, reverse=True))
    out = F.trim(F.lower(F.regexp_replace(col(name), "|".join(NOTES), "")))
    out = F.regexp_replace(out, rf"(?:[\s,.]*(?:{forms}))+$", "")
    out = F.regexp_replace(out, rf"^(?:(?:{forms})[\s,.]*)+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", ""), r"^[,.·、;:]+|[,.·、;:]+$", "")
    short = {k.lower().replace(" ", ""): v.lower().replace(" ", "") for k, v in (aliases or {}).items()}
    return F.coalesce(mapped(out, short, None), out) if short else out


def short_latin_name(name: Column | str) -> Column:
    """Whether a name is 2 to 5 Latin letters, &, ., - or blanks: too short to link by."""
    return F.coalesce(F.trim(col(name)).rlike(r"^[A-Za-z&.\- ]{2,5}$"), F.lit(False))


def group_head(name: Column | str) -> Column:
    """X of "X와 그 종속기업" and its like, else null."""
    found = F.regexp_extract(col(name), r"^(.+?)\s*(?:와|과|및)\s*그?\s*종속(?:기업|회사).*$", 1)
    return F.when(found != "", F.trim(found))


def account_name(name: Column | str) -> Column:
    """An account's name without tags, notes in brackets, numbering and blanks."""
    out = F.regexp_replace(col(name), r"<[^>]*>|\((?:주석|Note)[^)]*\)|\*+", "")
    out = F.regexp_replace(out, r"^\s*(?:[IVX]+|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[0-9]+|[가-힣])\s*[.)]\s*", "")
    return F.regexp_replace(out, r"\s+", "")


def slug(text: Column | str) -> Column:
    """Lower-case letters and digits with single dashes between."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def flat(text: Column | str) -> Column:
    """A text for a search of names: upper-case, letters and digits alone."""
    return F.upper(F.regexp_replace(col(text), r"[^\p{L}\p{N}]", ""))


def digits(code: Column | str) -> Column:
    """The digits of a code; null if it has none."""
    return F.nullif(F.regexp_replace(col(code), "[^0-9]", ""), F.lit(""))


def unlisted_uid(anchor: Column | str, name: Column | str) -> Column:
    """The id of a party without a code, by the firm that names it: x_ and 12 places of a hash of both."""
    return plain_uid(anchor, normal_name(name))


def plain_uid(anchor: Column | str, plain: Column | str) -> Column:
    """unlisted_uid of a name that is normal already."""
    return F.concat(F.lit("x_"), F.substring(F.sha1(F.concat_ws("|", col(anchor), col(plain))), 1, 12))


def news_link(base: str, company: Column | str, day: Column | str, around: int = 3) -> Column:
    """A search address for news on a company within days around a date."""
    date = lambda d: F.date_format(F.date_add(col(day), d), "yyyy-MM-dd")
    return F.concat(F.lit(base + "?q="), F.url_encode(col(company)), F.lit("&from="), date(-around), F.lit("&to="), date(around))


def sign_pattern(*values: Column | str) -> Column:
    """+, - or 0 for each value on end; null if one is."""
    return F.concat(*(F.when(col(v) > 0, "+").when(col(v) < 0, "-").when(col(v) == 0, "0") for v in values))
