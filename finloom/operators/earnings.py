"""Earnings quality of firms by five modules over their yearly panels.

A panel row has corp, year, groups (of peers, the nearest first, see industries.py) and measures; money is a double, any
may be null. contract_assets and industry_code may be there: with a financial code, receivables aren't scored.
Peer modules score against profiles of all firms of the group; a firm without peers has no score for the module.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.industries import is_financial, is_financial_group
from ..functions.numbers import grade, peer_score, piecewise, ratio, rounded
from .peers import profiles, with_profile

#: Knots of the cash-earnings module.
CASH_KNOTS = ((0.0, 0.0), (0.5, 25.0), (0.8, 50.0), (1.0, 80.0), (1.2, 100.0))
#: Which metrics are better high, and the shares of a margin's mean and range in its module.
BETTER_HIGH = {"receivable_gap": False, "leverage": False, "margin": True, "margin_range": False, "equity_growth": True}
MEAN_SHARE, RANGE_SHARE = 0.7, 0.3


def firm_metrics(panel: DataFrame) -> DataFrame:
    """One row for each firm: groups, financial, cash_ratio, receivable_gap, leverage, debt_known, equity and early (the last
    equity and that of two years before, or one), margin, margin_range, equity_growth and has_three (years). The last three
    years count, of which those with a null drop out afterwards. Contract assets, where the panel has them for both years,
    count with receivables. Gaps, margins and growth are fractions."""
    back = F.row_number().over(Window.partitionBy("corp").orderBy(F.col("year").desc()))
    assets = F.col("contract_assets") if "contract_assets" in panel.columns else F.lit(None).cast("double")
    code = F.col("industry_code") if "industry_code" in panel.columns else F.lit(None).cast("string")
    last = panel.select("*", assets.alias("_assets"), code.alias("_code"), back.alias("_b")).where("_b <= 3")
    at = lambda name, b: F.max(F.when(F.col("_b") == b, F.col(name)))
    both = F.col("operating_cashflow").isNotNull() & F.col("operating_income").isNotNull()
    rows = last.withColumn("_margin", ratio("operating_income", "revenue")).withColumn("_ok", both)
    weight = 3 - (F.count("_margin").over(Window.partitionBy("corp").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    count = F.count("_margin").over(Window.partitionBy("corp"))
    # the newest has the number of margins as weight, the oldest 1
    rows = rows.withColumn("_w", F.when(F.col("_margin").isNotNull(), weight - (3 - count)))
    one = rows.groupBy("corp").agg(
        F.max_by("groups", "year").alias("groups"), F.max_by("_code", "year").alias("_code"), F.count("*").alias("_years"),
        F.sum(F.when(F.col("_ok"), F.col("operating_cashflow"))).alias("_ocf"), F.sum(F.when(F.col("_ok"), F.col("operating_income"))).alias("_oi"), F.count_if("_ok").alias("_pairs"),
        at("receivable", 1).alias("_r1"), at("receivable", 2).alias("_r2"), at("_assets", 1).alias("_a1"), at("_assets", 2).alias("_a2"), at("revenue", 1).alias("_v1"), at("revenue", 2).alias("_v2"),
        at("total_liabilities", 1).alias("_debt"), at("total_equity", 1).alias("equity"), at("total_equity", 2).alias("_e2"), at("total_equity", 3).alias("_e3"),
        F.count("_margin").alias("_margins"), (F.sum(F.col("_margin") * F.col("_w")) / F.sum("_w")).alias("_mean"), (F.max("_margin") - F.min("_margin")).alias("_range"),
    )
    with_assets = F.col("_a1").isNotNull() & F.col("_a2").isNotNull()
    owed = lambda r, a: F.when(with_assets, F.coalesce(F.col(r), F.lit(0.0)) + F.col(a)).otherwise(F.col(r))
    gap = F.when(F.col("_v1") != 0, (ratio(owed("_r1", "_a1"), owed("_r2", "_a2")) - 1) - (ratio("_v1", "_v2") - 1))
    financial = F.coalesce(is_financial(F.col("_code")), F.lit(False))
    early = F.when(F.col("_years") >= 3, F.col("_e3")).otherwise(F.col("_e2"))
    power = F.when(F.col("_years") >= 3, 0.5).otherwise(1.0)
    enough = F.col("_margins") >= 2
    return one.select(
        "corp", "groups", financial.alias("financial"), (F.col("_years") >= 3).alias("has_three"), "equity", early.alias("early"), F.col("_debt").isNotNull().alias("debt_known"),
        F.when((F.col("_pairs") >= 2) & (F.col("_oi") > 0), F.col("_ocf") / F.col("_oi")).alias("cash_ratio"),
        F.when(~financial, gap).alias("receivable_gap"),
        F.when(F.col("equity") > 0, ratio("_debt", "equity")).alias("leverage"),
        F.when(enough, F.col("_mean")).alias("margin"), F.when(enough, F.col("_range")).alias("margin_range"),
        F.when((F.col("equity") > 0) & (early > 0), F.pow(F.col("equity") / early, power) - 1).alias("equity_growth"),
    )


def long_metrics(metrics: DataFrame, fitting: bool = False) -> DataFrame:
    """corp, groups, metric and value; when fitting, growth counts with three years alone."""
    names = [*BETTER_HIGH]
    values = [F.when(F.col("has_three"), F.col(n)) if fitting and n == "equity_growth" else F.col(n) for n in names]
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in zip(names, values, strict=True)))
    return metrics.select("corp", "groups", F.inline(pairs))


def calibrated(panel: DataFrame, fewest: int = 20, fewest_financial: int | None = None) -> DataFrame:
    """The peer profiles of all metrics of the panel's firms; groups of financial firms may need fewer."""
    needed = F.when(is_financial_group(F.col("group")), fewest if fewest_financial is None else fewest_financial).otherwise(fewest)
    return profiles(long_metrics(firm_metrics(panel), fitting=True), F.col("groups"), "metric", "value", needed)


def mean_of_available(scores: list[Column]) -> Column:
    """The mean of those that aren't null, to one place; null if none is."""
    n = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in scores])
    return rounded(ratio(reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores]), n), 1)


def _modules(metrics: DataFrame, m2: Column, m3: Column, m4: Column, m5: Column) -> DataFrame:
    """corp, m1 to m5 to one place, total, grade and excluded; equity of 0 or less decides m3 and m5."""
    broke = F.col("equity") <= 0
    scored = metrics.select(
        "corp", rounded(piecewise("cash_ratio", CASH_KNOTS), 1).alias("m1"), rounded(m2, 1).alias("m2"),
        F.when(broke & F.col("debt_known"), 0.0).otherwise(rounded(m3, 1)).alias("m3"), rounded(m4, 1).alias("m4"),
        F.when(F.col("equity").isNotNull() & F.col("early").isNotNull() & (broke | (F.col("early") <= 0)), 0.0).otherwise(rounded(m5, 1)).alias("m5"),
    )
    names = [f"m{i}" for i in range(1, 6)]
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in names))), ",")
    total = mean_of_available([F.col(n) for n in names])
    return scored.withColumn("total", total).withColumn("grade", grade("total")).withColumn("excluded", missing)


def quality_scores(panel: DataFrame, found: DataFrame) -> DataFrame:
    """corp, m1 to m5 against the profiles found, total (the mean of those there are), grade and excluded (the others)."""
    metrics = firm_metrics(panel)
    rows = with_profile(long_metrics(metrics), F.col("groups"), "metric", found, ["corp"])
    score = F.coalesce(*(F.when(F.col("metric") == n, peer_score("value", F.col("profile"), high)) for n, high in BETTER_HIGH.items()))
    wide = rows.groupBy("corp").agg(*(F.max(F.when(F.col("metric") == n, score)).alias(f"_{n}") for n in BETTER_HIGH))
    joined = metrics.join(wide, "corp")
    return _modules(joined, F.col("_receivable_gap"), F.col("_leverage"), F.col("_margin") * MEAN_SHARE + F.col("_margin_range") * RANGE_SHARE, F.col("_equity_growth"))


#: Knots of scores without peers, of the receivable gap and of equity growth.
GAP_KNOTS = ((-0.10, 100.0), (0.0, 80.0), (0.10, 50.0), (0.30, 0.0))
GROWTH_KNOTS = ((-0.10, 0.0), (0.0, 50.0), (0.10, 80.0), (0.20, 95.0), (0.30, 100.0))
#: Debt to equity that scores 80, 60, 35 and 0 (0 scores 100), by industry.
LEVERAGE_BOUNDS = {
    "ict_software": (0.30, 0.60, 1.20, 2.50), "manufacturing": (0.50, 1.00, 2.00, 4.00), "chemicals": (0.60, 1.20, 2.20, 4.50), "utility": (0.80, 1.50, 2.80, 5.00),
    "retail": (0.50, 1.00, 2.00, 4.00), "construction": (1.00, 2.00, 3.50, 6.00), "transport": (1.00, 2.00, 3.50, 6.00), "fin_holding": (8.00, 12.00, 17.00, 25.00),
    "bank": (8.00, 12.00, 17.00, 25.00), "securities": (2.00, 4.00, 6.00, 10.00), "life_insurance": (7.00, 11.00, 15.00, 22.00), "non_life_insurance": (4.00, 7.00, 11.00, 17.00),
}
#: Mean margins that score 0, 20, 50, 80 and 100, by industry.
MARGIN_BOUNDS = {
    "ict_software": (-0.05, 0.0, 0.10, 0.20, 0.30), "biotech": (-0.10, 0.0, 0.08, 0.20, 0.35), "manufacturing": (-0.05, 0.0, 0.05, 0.10, 0.15), "chemicals": (-0.03, 0.0, 0.04, 0.08, 0.12),
    "automotive": (-0.03, 0.0, 0.04, 0.08, 0.12), "retail": (-0.02, 0.0, 0.02, 0.04, 0.07), "construction": (-0.03, 0.0, 0.03, 0.06, 0.10), "transport": (-0.05, 0.0, 0.04, 0.10, 0.15),
    "utility": (-0.03, 0.0, 0.02, 0.05, 0.08), "fin_holding": (-0.05, 0.0, 0.25, 0.35, 0.45), "bank": (-0.05, 0.0, 0.25, 0.35, 0.45), "securities": (-0.10, 0.0, 0.10, 0.25, 0.40),
    "life_insurance": (-0.05, 0.0, 0.05, 0.12, 0.20), "non_life_insurance": (-0.03, 0.0, 0.05, 0.10, 0.18),
}
#: Ranges of margins that score 100, 70, 50 and 0, by kind of industry.
RANGE_BOUNDS = {
    "stable": (0.02, 0.04, 0.07, 0.12), "general": (0.03, 0.07, 0.10, 0.20), "cyclic": (0.08, 0.15, 0.25, 0.50),
    "fin_stable": (0.03, 0.05, 0.08, 0.15), "fin_volatile": (0.03, 0.07, 0.10, 0.20), "fin_cyclic": (0.08, 0.15, 0.25, 0.50),
}
LEVERAGE_SCORES, MARGIN_SCORES, RANGE_SCORES = (80.0, 60.0, 35.0, 0.0), (0.0, 20.0, 50.0, 80.0, 100.0), (100.0, 70.0, 50.0, 0.0)


def _bounded(value: str, bucket: str, table: dict, default: str, scores: tuple, first: tuple = ()) -> Column:
    """Piecewise by the bounds of a bucket, or of the default for a bucket that isn't there."""
    of = lambda bounds: piecewise(value, [*first, *zip(bounds, scores, strict=True)])
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, bounds in table.items():
        if name != default:
            out = out.when(F.col(bucket) == name, of(bounds))
    return out.otherwise(of(table[default]))


def with_buckets(firms: DataFrame, book: DataFrame) -> DataFrame:
    """firms (corp, name) with leverage_bucket, margin_bucket and range_bucket by the exact name, trimmed, from book (a
    rule table with name and these); manufacturing, manufacturing and general for others."""
    names = ("leverage_bucket", "margin_bucket", "range_bucket")
    held = book.select(F.col("name").alias("_name"), *names)
    met = firms.join(held, F.trim("name") == F.col("_name"), "left").drop("_name")
    return met.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in zip(names, ("manufacturing", "manufacturing", "general"), strict=True)})


def absolute_scores(panel: DataFrame, buckets: DataFrame) -> DataFrame:
    """quality_scores without peers: by fixed scales of the firms' buckets (corp, leverage_bucket, margin_bucket,
    range_bucket). Firms without a row have the default scales."""
    rows = firm_metrics(panel).join(buckets.select("corp", "leverage_bucket", "margin_bucket", "range_bucket"), "corp", "left")
    lever = _bounded("leverage", "leverage_bucket", LEVERAGE_BOUNDS, "manufacturing", LEVERAGE_SCORES, ((0.0, 100.0),))
    margin = _bounded("margin", "margin_bucket", MARGIN_BOUNDS, "manufacturing", MARGIN_SCORES) * MEAN_SHARE
    spread = _bounded("margin_range", "range_bucket", RANGE_BOUNDS, "general", RANGE_SCORES) * RANGE_SHARE
    return _modules(rows, piecewise("receivable_gap", GAP_KNOTS), lever, margin + spread, piecewise("equity_growth", GROWTH_KNOTS))


def dividend_score(yearly: DataFrame, key: str, year: str, dps: str) -> DataFrame:
    """key and continuity of the last three years with a number, what is negative as 0: 35, 60 or 75 for one, two or three
    years with a dividend, less 20 for each cut of over 10 %, 7.5 more for each rise of over 5 % (from 0 too), 10 more if
    no year lacks one and none is cut; from 0 to 100."""
    last = yearly.where(F.col(dps).isNotNull()).select(key, F.col(year).alias("_y"), F.greatest(F.col(dps), F.lit(0.0)).alias("_d"), F.row_number().over(Window.partitionBy(key).orderBy(F.desc(year))).alias("_b")).where("_b <= 3")
    steps = last.withColumn("_p", F.lag("_d").over(Window.partitionBy(key).orderBy("_y")))
    one = steps.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("_d") > 0).alias("paid"), F.count_if((F.col("_p") > 0) & (F.col("_d") < F.col("_p") * 0.9)).alias("cuts"), F.count_if(F.col("_d") > F.col("_p") * 1.05).alias("rises"))
    base = F.when(F.col("paid") >= 3, 75.0).when(F.col("paid") == 2, 60.0).otherwise(35.0)
    unbroken = F.when((F.col("paid") == F.col("n")) & (F.col("cuts") == 0), 10.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - 20 * F.col("cuts") + 7.5 * F.col("rises") + unbroken))
    return one.select(key, F.when(F.col("paid") > 0, score).otherwise(0.0).alias("continuity"))


#: Highlights of a firm's last year by severity.
SEVERITY = (("negative_equity", 10), ("operating_loss", 9), ("cash_gap", 8), ("receivable_gap", 8), ("debt_jump", 7), ("margin_drop", 6), ("leverage", 6), ("strong_cash", 4))


def highlights(panel: DataFrame, most: int = 3) -> DataFrame:
    """corp and highlights: names of the rules that the last year meets against the one before, the gravest first, by
    SEVERITY and its order, most at most."""
    w = Window.partitionBy("corp").orderBy("year")
    names = ("receivable", "revenue", "total_liabilities", "operating_income")
    last = panel.select("*", *(F.lag(n).over(w).alias(f"_{n}") for n in names), F.row_number().over(Window.partitionBy("corp").orderBy(F.desc("year"))).alias("_b")).where("_b = 1")
    there = lambda *ns: reduce(lambda a, b: a & b, [F.col(n) != 0 for n in ns])
    grew = lambda n: (F.col(n) - F.col(f"_{n}")) / F.col(f"_{n}")
    gain, cash = F.col("net_income") > 0, ratio("operating_cashflow", "net_income")
    tests = {
        "negative_equity": F.col("total_equity") < 0, "operating_loss": F.col("operating_income") < 0, "cash_gap": gain & (cash < 0.3),
        "receivable_gap": F.when(there("revenue", "_revenue", "receivable", "_receivable"), grew("receivable") - grew("revenue") >= 0.15),
        "debt_jump": F.when(there("total_liabilities", "_total_liabilities"), grew("total_liabilities") >= 0.30),
        "margin_drop": ratio("_operating_income", "_revenue") - ratio("operating_income", "revenue") >= 0.05,
        "leverage": ratio("total_liabilities", "total_assets") >= 0.70, "strong_cash": gain & (cash >= 1.2),
    }
    # an ordered list: the stable order of SEVERITY is by severity already
    found = F.array_compact(F.array(*(F.when(tests[n], n) for n, _ in SEVERITY)))
    return last.select("corp", F.array_join(F.slice(found, 1, most), ",").alias("highlights"))
