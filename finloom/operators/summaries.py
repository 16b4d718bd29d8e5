"""Summaries of firms, groups and passes, each by aggregates that combine before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.numbers import rounded


def group_means(firms: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """firms (rows) and the mean of each measure, nulls left out, by group; rows of no group don't count. Who belongs to a
    group stays in firms: a list of all members would grow with the group."""
    return firms.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("firms"), *(F.avg(m).alias(m) for m in measures))


def score_summary(scores: DataFrame, total: str, grade: str, modules: Sequence[str]) -> DataFrame:
    """One row: firms, scored, unscored, those of each grade, and means of the modules and the total of the scored ones, to
    one place (half to even)."""
    scored = F.col(total).isNotNull()
    mean = lambda c: rounded(F.avg(F.when(scored, F.col(c))), 1)
    return scores.agg(
        F.count("*").alias("firms"), F.count(total).alias("scored"), (F.count("*") - F.count(total)).alias("unscored"),
        *(F.count_if(scored & (F.col(grade) == g)).alias(f"grade_{g}") for g in "ABCDF"), *(mean(m).alias(f"mean_{m}") for m in modules), mean(total).alias("mean_total"),
    )


def group_price_earnings(members: DataFrame, group: str, cap: str, income: str, most: float = 200.0) -> DataFrame:
    """All caps over all incomes of a group's members with a cap and a positive income, to one place; null unless between 0
    and most."""
    counted = (F.col(cap) > 0) & (F.col(income) > 0)
    sums = members.groupBy(group).agg(F.sum(F.when(counted, F.col(cap))).alias("_cap"), F.sum(F.when(counted, F.col(income))).alias("_income"))
    per = F.try_divide("_cap", "_income")
    return sums.select(group, F.when((per > 0) & (per < most), F.round(per, 1)).alias("per"))


def overlap(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """One row: both, only_ours, only_theirs and the percent of theirs that is in ours (0 if there are none)."""
    flags = ours.select(key, F.lit(1).alias("_o"), F.lit(0).alias("_t")).unionByName(theirs.select(key, F.lit(0).alias("_o"), F.lit(1).alias("_t"))).groupBy(key).agg(F.max("_o").alias("_o"), F.max("_t").alias("_t"))
    count = lambda o, t: F.count_if((F.col("_o") == o) & (F.col("_t") == t))
    sums = flags.agg(count(1, 1).alias("both"), count(1, 0).alias("only_ours"), count(0, 1).alias("only_theirs"))
    return sums.select("*", F.coalesce(F.round(F.try_divide(F.col("both") * 100.0, F.col("both") + F.col("only_theirs")), 1), F.lit(0.0)).alias("overlap_pct"))


def pass_agreement(chunks: DataFrame, first: DataFrame, second: DataFrame, chunk: str, fields: Sequence[str]) -> DataFrame:
    """For each chunk: in_first, in_second, agree (in both, with the same set of tuples of fields). A pass that found nothing
    in a chunk has a row of null fields there. A missing chunk agrees with nothing."""
    marked = lambda df, a, b: df.select(chunk, *fields, F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    tuples = marked(first, 1, 0).unionByName(marked(second, 0, 1)).groupBy(chunk, *fields).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    empty = F.lit(True)
    for f in fields:
        empty = empty & F.col(f).isNull()
    seen = tuples.groupBy(chunk).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.count_if(~empty & (F.col("_a") != F.col("_b"))).alias("_unlike"))
    has = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return chunks.select(chunk).join(seen, chunk, "left").select(chunk, has("_a").alias("in_first"), has("_b").alias("in_second"), (has("_a") & has("_b") & (F.coalesce(F.col("_unlike"), F.lit(0)) == 0)).alias("agree"))


def standard_peers(firms: DataFrame, key: str, group: str, tier: str) -> DataFrame:
    """key, group, standard: for each firm the firm of its group, other than itself, of the lowest tier up to 1 (ties: the
    lowest key); null without one. Two rounds of minima by group give its two best, so no firms are paired."""
    able = firms.where(F.col(tier) <= 1).select(group, F.struct(tier, key).alias("_s"))
    best = able.groupBy(group).agg(F.min("_s").alias("_best"))
    second = able.join(best, group).where("_s <> _best").groupBy(group).agg(F.min("_s").alias("_second"))
    found = best.join(second, group, "left").select(group, F.col(f"_best.{key}").alias("_b"), F.col(f"_second.{key}").alias("_s"))
    return firms.select(key, group).join(found, group, "left").select(key, group, F.when(F.col("_b") != F.col(key), F.col("_b")).otherwise(F.col("_s")).alias("standard"))


#: Pivots below this count as none.
LEAST_PIVOT = 1e-12


def _solved(a: np.ndarray, b: np.ndarray) -> list[float] | None:
    """x of a x = b by elimination with the largest pivot of each column; None if a pivot is too small."""
    m = np.column_stack([a, b]).astype(float)
    for i in range(len(m)):
        at = i + int(np.argmax(np.abs(m[i:, i])))
        if not abs(m[at, i]) >= LEAST_PIVOT:
            return None
        m[[i, at]] = m[[at, i]]
        m[i] /= m[i, i]
        rest = np.arange(len(m)) != i
        m[rest] -= np.outer(m[rest, i], m[i])
    return m[:, -1].tolist()


def linear_fits(rows: DataFrame, group: str, target: str, regressors: Sequence[str], intercept: bool = True) -> DataFrame:
    """n and coefficients (the intercept first) of least squares by group, over rows without nulls; coefficients are null
    with fewer rows than unknowns or for unknowns that depend on each other. Spark sums the products, so a group of any
    size is one row of k * (k + 1) sums before it is solved."""
    x = [F.lit(1.0)] * intercept + [F.col(c).cast("double") for c in regressors]
    k, y = len(x), F.col(target).cast("double")
    sums = rows.dropna(subset=[target, *regressors]).groupBy(group).agg(F.count("*").alias("n"), F.array(*(F.sum(a * b) for a in x for b in [*x, y])).alias("_sums"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = [np.array(s, float).reshape(k, k + 1) for s in batch["_sums"]]
            yield batch.assign(coefficients=[_solved(m[:, :-1], m[:, -1]) if n >= k else None for n, m in zip(batch["n"], whole, strict=True)])[[group, "n", "coefficients"]]

    return sums.mapInPandas(fitted, sums.select(group, "n").schema.add("coefficients", ArrayType(DoubleType())))


#: Kinds of relations, the foremost first, and those of equity.
KIND_ORDER = ("subsidiary", "associate", "investment", "ftc_group", "dart_filing", "manual")
EQUITY_KINDS = ("subsidiary", "associate", "investment")


def merged_kinds(edges: DataFrame, keys: Sequence[str], kind: str, direction: str) -> DataFrame:
    """One row for each keys: its kinds in order (comma-joined), the foremost, whether that comes in, and whether one is of
    equity. Where a kind has both directions, in counts."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col(kind)), F.lit(0)), F.lit(9)).cast("int")
    each = edges.groupBy(*keys, kind).agg(F.max((F.col(direction) == "in").cast("int")).alias("_in"))
    out = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col(kind).alias("kind"), F.col("_in").alias("i")))).alias("_ks"), F.max(F.col(kind).isin(*EQUITY_KINDS)).alias("has_equity"))
    return out.select(*keys, F.array_join("_ks.kind", ",").alias("kinds"), F.col("_ks")[0]["kind"].alias("kind"), (F.coalesce(F.col("_ks")[0]["i"], F.lit(0)) == 1).alias("incoming"), "has_equity")


def complete_years(rows: DataFrame, key: str, year: str, measures: Sequence[str]) -> DataFrame:
    """For each key: first (year with all measures), full (every year has them) and complete (years that have them)."""
    whole = F.lit(True)
    for m in measures:
        whole = whole & F.col(m).isNotNull()
    return rows.groupBy(key).agg(F.min(F.when(whole, F.col(year))).alias("first"), F.bool_and(whole).alias("full"), F.count_if(whole).alias("complete"))


def per_hundred(measures: Sequence[str], base: str) -> list[Column]:
    """Measures as percent of base, null where that is null or 0: series of firms of any size side by side."""
    return [(F.try_divide(F.col(m).cast("double"), F.col(base).cast("double")) * 100).alias(m) for m in measures]


def missing_counts(scores: DataFrame, modules: Sequence[str]) -> DataFrame:
    """module, missing: how many firms lack each module."""
    long = scores.select(F.explode(F.array(*(F.struct(F.lit(m).alias("module"), F.col(m).isNull().cast("int").alias("x")) for m in modules))).alias("m"))
    return long.groupBy("m.module").agg(F.sum("m.x").alias("missing"))
