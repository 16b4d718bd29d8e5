"""Column builders for numbers: ratios, piecewise scores, classes, amounts and their labels.

All take and return columns and stay in whole-stage code; a null argument gives null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str, times: float = 1.0) -> Column:
    """a / b * times; null where b is null or 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double")) * times


def piecewise(value: Column | str, knots: Sequence[tuple[Column | float, Column | float]]) -> Column:
    """Linear between knots (x, y) of rising x, flat outside. Knots of one x step to the later y."""
    v, lit = col(value), lambda x: x if isinstance(x, Column) else F.lit(float(x))
    points = [(lit(x), lit(y)) for x, y in knots]
    out = F.when(v.isNull(), F.lit(None).cast("double")).when(v <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(v <= x1, F.when(x1 == x0, y1).otherwise(y0 + F.try_divide(v - x0, x1 - x0) * (y1 - y0)))
    return out.otherwise(points[-1][1])


def rounded(value: Column | str, places: int) -> Column:
    """A double to so many places, as its exact binary value says: 24.95 lies below the middle and gives 24.9; only what is
    exactly in the middle (0.25) goes to the even digit. For values up to 2^30."""
    p = float(10**places)

    def nearest(v: Column) -> Column:
        x = F.abs(v)
        low = F.floor(x * p).cast("double")
        # the first 20 binary places and the rest apart, so that no product is rounded
        high = F.floor(x * 2.0**20).cast("double") / 2.0**20
        over = (high * (2 * p) - (low * 2 + 1)) + (x - high) * (2 * p)
        return F.signum(v) * F.when((over > 0) | ((over == 0) & (low % 2 == 1)), low + 1).otherwise(low) / p

    # as an array of one, so that the value stands once in the generated code
    return F.get(F.transform(F.array(col(value).cast("double")), nearest), F.lit(0))


#: Scores at the percentiles 10, 25, 50, 75 and 90 of the peers.
PEER_PERCENTILES, PEER_SCORES = (0.10, 0.25, 0.50, 0.75, 0.90), (0.0, 25.0, 50.0, 75.0, 100.0)


def peer_score(value: Column | str, profile: Column, higher_is_better: bool = True) -> Column:
    """The score of a value among its peers, to one place. profile: an array of the peers' values at PEER_PERCENTILES."""
    scores = PEER_SCORES if higher_is_better else PEER_SCORES[::-1]
    score = piecewise(value, [(F.get(profile, F.lit(i)), y) for i, y in enumerate(scores)])
    return F.when(profile.isNotNull(), rounded(score, 1))


def classes(value: Column | str, bounds: Sequence[tuple[float, str]], rest: str | None, strict: Sequence[float] = ()) -> Column:
    """The name of the first bound that the value reaches (or passes, if it is in strict); else rest."""
    v, out = col(value), F.when(col(value).isNull(), F.lit(None).cast("string"))
    for bound, name in bounds:
        out = out.when(v > bound if bound in strict else v >= bound, name)
    return out.otherwise(F.lit(rest).cast("string"))


def grade(score: Column | str) -> Column:
    """A from 75, B from 60, C from 50, D from 25, else F."""
    return classes(score, [(75, "A"), (60, "B"), (50, "C"), (25, "D")], "F")


def ownership(share: Column | str) -> Column:
    """subsidiary above 50 %, associate from 20, investment from 5, else null."""
    return classes(share, [(50, "subsidiary"), (20, "associate"), (5, "investment")], None, strict=[50])


def return_label(change: Column | str, bound: float = 2.0) -> Column:
    """positive from +bound on, negative down from -bound, else neutral; bounds count."""
    c = col(change)
    return F.when(c >= bound, "positive").when(c <= -bound, "negative").when(c.isNotNull(), "neutral")


def volatility_class(index: Column | str) -> Column:
    """low below 15, medium below 25, else high."""
    return F.when(col(index) < 15, "low").when(col(index) < 25, "medium").when(col(index).isNotNull(), "high")


def cap_bucket(cap: Column | str) -> Column:
    """3 from 5e12 on, 2 from 1e12, 1 from 2e11, else 0, null too."""
    c = col(cap)
    return F.when(c >= 5e12, 3).when(c >= 1e12, 2).when(c >= 2e11, 1).otherwise(0)


def scaled_size(cap: Column | str, reference: float = 100_000.0) -> Column:
    """0.5 and 0.3 of the root of a cap against a reference, 3.5 at most; 0.5 for null and what isn't positive."""
    c = col(cap)
    return F.when(c > 0, F.least(F.sqrt(c / reference) * 0.3 + 0.5, F.lit(3.5))).otherwise(F.lit(0.5))


def cagr(first: Column | str, last: Column | str, years: Column | float) -> Column:
    """Yearly growth from first to last; null unless both and years are positive."""
    a, b, n = col(first), col(last), years if isinstance(years, Column) else F.lit(float(years))
    return F.when((a > 0) & (b > 0) & (n > 0), F.pow(b / a, 1 / n) - 1)


def balance_gap(assets: Column | str, liabilities: Column | str, equity: Column | str) -> Column:
    """|assets - (liabilities + equity)| / |assets|."""
    return F.try_divide(F.abs(col(assets) - (col(liabilities) + col(equity))), F.abs(col(assets)))


def valuation(cap: Column | str, income: Column | str, equity: Column | str) -> tuple[Column, Column, Column]:
    """(price/earnings, price/book, return on equity in %), each null where its denominator isn't positive."""
    over = lambda a, b, k=1.0: F.when(col(b) > 0, col(a) / col(b) * k)
    return over(cap, income), over(cap, equity), over(income, equity, 100.0)


def share(value: Column | str) -> Column:
    """A share between 0 and 1: what is above 1 counts as percent, what is negative as null; 4 places."""
    v = col(value).try_cast("double") if not isinstance(value, str) else F.col(value).try_cast("double")
    return F.round(F.when(v < 0, None).when(v > 1, v / 100).otherwise(v), 4)


def amount(text: Column | str) -> Column:
    """A number written with commas, after tags and hard blanks are gone; in brackets, or after one minus sign or triangle,
    negative; anything else, a lone dash or blank too, is null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(col(text), "<[^>]*>", ""), "&nbsp;|[\u3000\u00a0]", " "))
    inner = F.when(t.rlike(r"^\(.*\)$"), F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    bare = F.regexp_replace(F.regexp_replace(inner, "^[△▲▵−-]", ""), "[, ]", "")
    number = F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.try_cast("double"))
    return F.when((inner != t) | inner.rlike("^[△▲▵−-]"), -number).otherwise(number)


def percent(text: Column | str) -> Column:
    """The number of a text such as 12.34%."""
    return F.regexp_replace(F.trim(col(text)), "[%,\\s]", "").try_cast("double")


def won_label(value: Column | str) -> Column:
    """An amount of won as 조 from 1e12 on, with one place, as 억 from 1e8 on, else as 원, without; null is a dash."""
    v, size = col(value), F.abs(col(value))
    jo = F.concat(F.format_string("%.1f", size / 1e12), F.lit("조"))
    label = F.when(size >= 1e12, jo).when(size >= 1e8, F.concat(F.format_number(size / 1e8, 0), F.lit("억"))).otherwise(F.concat(F.format_number(size, 0), F.lit("원")))
    return F.when(v.isNull(), "—").otherwise(F.concat(F.when(v < 0, "-").otherwise(""), label))


def won_amount(label: Column | str) -> Column:
    """The won of a label such as 1,210.2조 or 350억; null for others."""
    clean = F.regexp_replace(col(label), "[,\\s]", "")
    number = F.regexp_extract(clean, r"^(-?[0-9.]+)(조|억)", 1).try_cast("double")
    return number * F.when(F.regexp_extract(clean, r"^(-?[0-9.]+)(조|억)", 2) == "조", 1e12).otherwise(1e8)


def display_unit(assets: Column | str) -> Column:
    """조 from assets of 3e12 on, else 억."""
    return F.when(col(assets) >= 3e12, "조").otherwise("억")


def parsed_verdict(truth: Column | str, parsed: Column | str) -> Column:
    """How a parsed number stands to the true one, both as whole numbers: exact, zero (one of them), unit (1e3 or 1e6 times
    or part, by a millionth), sign, near (below 0.1 %), off (below 5 %), wrong, missing."""
    t, p = F.bround(col(truth), 0), F.bround(col(parsed), 0)
    ratio_ = F.try_divide(p, t)
    unit = reduce(lambda a, b: a | b, (F.abs(ratio_ - s) < s * 1e-6 for s in (1e3, 1e-3, 1e6, 1e-6)))
    gap = F.abs(p - t) / F.greatest(F.abs(t), F.lit(1.0))
    out = F.when(t.isNull() | p.isNull(), "missing").when(t == p, "exact").when((t == 0) | (p == 0), "zero").when(unit, "unit")
    return out.when(F.abs(ratio_ + 1) < 1e-9, "sign").when(gap < 0.001, "near").when(gap < 0.05, "off").otherwise("wrong")


def issue_amount(text: Column | str) -> Column:
    """The won of an issue that a filing's text states (발행 총금액 and its like), with its unit; null if none is stated."""
    pattern = r"발행\s*(?:예정\s*)?(?:총\s*)?금액[^0-9]*?([\d,]+)\s*(백만원|억원|천원|원)?"
    number = F.nullif(F.regexp_replace(F.regexp_extract(col(text), pattern, 1), ",", ""), F.lit("")).try_cast("double")
    unit = F.regexp_extract(col(text), pattern, 2)
    return number * F.when(unit == "백만원", 1e6).when(unit == "억원", 1e8).when(unit == "천원", 1e3).otherwise(1.0)


def dilution(issue: Column | str, cap: Column | str) -> Column:
    """An issue in percent of a cap, 4 places; null unless both are positive."""
    return F.when((col(issue) > 0) & (col(cap) > 0), rounded(col(issue) / col(cap) * 100, 4))


def profitability(revenue: str, cogs: str, operating: str, net: str, equity: str, assets: str) -> dict[str, Column]:
    """Five ratios in percent, each null where a part is null or the base is null or 0."""
    return {
        "gross_margin": ratio(F.col(revenue) - F.col(cogs), revenue, 100.0), "operating_margin": ratio(operating, revenue, 100.0),
        "net_margin": ratio(net, revenue, 100.0), "roe": ratio(net, equity, 100.0), "roa": ratio(net, assets, 100.0),
    }


def top_percent(percentile: Column | str, peers: Column | str) -> Column:
    """Of a percentile, the share at the top it stands for, 1 at least; null below three peers, which a null doesn't mean."""
    p = col(percentile)
    return F.when(p.isNotNull() & (F.coalesce(col(peers), F.lit(3)) >= 3), F.greatest(F.lit(1), F.floor(100 - p + 0.5)).cast("int"))


def places(values: Column, unit: Column | str) -> Column:
    """Decimal places that suit an array of amounts: for 억 none from 1,000 on, else 1; for others 1, 2 or 3 by size."""
    most = F.coalesce(F.array_max(F.transform(values, lambda v: F.abs(v))), F.lit(0.0))
    return F.when(col(unit).startswith("억"), F.when(most >= 1000, 0).otherwise(1)).otherwise(F.when(most >= 10, 1).when(most >= 1, 2).otherwise(3))


def rounded_alike(values: Column, unit: Column | str) -> Column:
    """An array of amounts, all to the places that suit it; no negative zero."""
    n = places(values, unit)
    by = lambda v: F.when(n == 0, F.bround(v, 0)).when(n == 1, rounded(v, 1)).when(n == 2, rounded(v, 2)).otherwise(rounded(v, 3))
    return F.transform(values, lambda v: by(v) + F.lit(0.0))


def last_valid(values: Column) -> Column:
    """The last number of an array that is neither null nor NaN."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(-1))


def valley(values: Column) -> Column:
    """The place (from 0) of the least of an array's numbers, the first if several; null below three numbers."""
    held = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(held) >= 3, F.array_position(values, F.array_min(held)).cast("int") - 1)


def immaterial(share_: Column | str) -> Column:
    """Whether a share of revenue is below 1 %: what is above 1 counts as percent."""
    v = col(share_)
    return F.coalesce(F.when(v > 1, v / 100).otherwise(v) < 0.01, F.lit(False))
