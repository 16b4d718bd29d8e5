"""Titles of filings: which are noise, which come first, what type they are, and whether they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import col
from ..functions.texts import hits

#: Patterns of titles that are left out, that wait, that are read at once.
NOISE = ("주주총회소집공고", r"사외이사\s*선임", r"보고서\s*제출", r"IR\s*개최", "소수주주권.*행사", "임원주주특정증권등소유보고서", "의결권대리행사권유참고서류")
WAITING = ("최대주주등소유주식변동신고서", "증권발행실적보고서")
AT_ONCE = ("사업보고서", "분기보고서", "반기보고서", "유상증자", "무상증자", "전환사채", "신주인수권", "합병", "분할", "영업양수", "영업양도", "매출액.*변동", "손익.*변동", "실적발표")
#: Words that raise a title's priority by one each.
PRIORITY = ("공급계약", "시설투자", "대표이사", "사내이사", "유상증자", "무상증자", "전환사채", "신주인수권", "합병", "분할", "영업양수도", "자기주식", "매출액변동", "손익변동", "실적발표", "회사채", "기업어음", "단기사채")
#: Types by pattern, the first that fits; a title of none is of the last type.
TYPES = (
    ("사업보고서|분기보고서|반기보고서", "정기보고서"), ("임원.{0,6}주요주주.{0,10}소유상황", "내부자거래"), ("최대주주.*변동|변동.*최대주주", "최대주주변동"), ("유상증자|무상증자", "증자"), ("전환사채", "전환사채"),
    ("신주인수권", "BW"), ("합병|분할", "M&A/분할"), ("영업양수|영업양도", "영업양도"), ("공급계약|수주계약|계약체결", "계약"), ("시설투자|(?i:CAPEX)", "CAPEX"), ("대표이사|사내이사|임원", "임원변동"),
    ("매출액|손익|실적", "실적"), ("자기주식", "자기주식"), ("회사채|기업어음", "채권발행"),
)
OTHER = "기타"
#: Types that are shown.
SHOWN = ("정기보고서", "증자", "전환사채", "BW", "M&A/분할", "영업양도", "계약", "CAPEX", "실적", "자기주식", "채권발행")


def _any(title: Column | str, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(col(title).rlike("|".join(patterns)), F.lit(False))


def is_noise(title: Column | str) -> Column:
    """Whether a title is left out; a null isn't."""
    return _any(title, NOISE)


def tier(title: Column | str) -> Column:
    """immediate, later (waiting) or normal; a title of both first kinds waits."""
    return F.when(_any(title, WAITING), "later").when(_any(title, AT_ONCE), "immediate").otherwise("normal")


def priority(title: Column | str) -> Column:
    """How many of the words of PRIORITY a title has."""
    return hits(title, list(PRIORITY))


def filing_type(title: Column | str) -> Column:
    """The type of the first pattern of TYPES that fits; OTHER for none and for a null."""
    out = F.when(F.lit(False), F.lit(OTHER))
    for pattern, name in TYPES:
        out = out.when(col(title).rlike(pattern), name)
    return out.otherwise(OTHER)


def is_shown(kind: Column | str, title: Column | str, high_impact: Column) -> Column:
    """Whether a filing is shown: of high impact, of a type of SHOWN, or a periodic report by its title."""
    return F.coalesce(high_impact, F.lit(False)) | F.coalesce(col(kind).isin(*SHOWN), F.lit(False)) | _any(title, (TYPES[0][0],))
