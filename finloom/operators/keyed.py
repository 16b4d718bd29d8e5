"""Rows by key: the latest, the first few, the preferred one; merges, prunes and comparisons of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key by order; with rank also their place. Spark limits each partition's groups to n
    rows before the shuffle, so a hot key moves no more than others."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order."""
    return top_per_key(df, keys, order, 1)


def latest_then(df: DataFrame, keys: Sequence[str], order: Sequence[Column], condition: Column) -> DataFrame:
    """The latest rows that meet a condition: it is asked of the latest of all rows, so an ended row hides older ones."""
    return latest_per_key(df, keys, order).where(condition)


def absent(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose key old lacks; null keys are never there."""
    return new.join(old.select(*keys).distinct(), [*keys], "left_anti")


def first_by_priority(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row for each key, from the first table that has it; within a table the least row by its columns."""
    parts = [t.withColumn("_priority", F.lit(i)) for i, t in enumerate(tables)]
    whole = parts[0]
    for t in parts[1:]:
        whole = whole.unionByName(t)
    rest = [F.col(c) for c in whole.columns if c not in (*keys, "_priority")]
    return latest_per_key(whole, keys, [F.col("_priority"), *rest]).drop("_priority")


def undirected(df: DataFrame, a: str, b: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each pair in either direction and key, the first by order, as it was."""
    paired = df.withColumns({"_low": F.least(a, b), "_high": F.greatest(a, b)})
    return latest_per_key(paired, ["_low", "_high", *keys], order).drop("_low", "_high")


def neither_way(df: DataFrame, blocked: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of df whose pair isn't blocked in either direction."""
    low, high = F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")
    held = blocked.select(low, high).distinct()
    return df.withColumns({"_low": F.least(a, b), "_high": F.greatest(a, b)}).join(held, ["_low", "_high"], "left_anti").drop("_low", "_high")


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and state (added, removed, changed or same) of each key of either table, by a hash of the other columns."""
    digest = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys))), 256).alias(name))
    both = digest(old, "_old").join(digest(new, "_new"), [*keys], "full_outer")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return both.select(*keys, state.alias("state"))


def pruned(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(nodes that an edge touches, edges whose two ends are nodes)."""
    ids = nodes.select(F.col(node).alias("_id")).distinct()
    kept = edges.join(ids, F.col(a) == F.col("_id"), "left_semi").join(ids, F.col(b) == F.col("_id"), "left_semi")
    ends = kept.select(F.col(a).alias("_end")).union(kept.select(F.col(b))).distinct()
    return nodes.join(ends, F.col(node) == F.col("_end"), "left_semi"), kept


def filled(index: DataFrame, rows: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """A row for each key of index, with defaults where rows has none or a null."""
    return index.select(*keys).distinct().join(rows, [*keys], "left").fillna(defaults)
