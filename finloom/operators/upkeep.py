"""Keeping relations and items in order: ends that the notes no longer show, merged nodes, stale rows, mixed bases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absent_from_notes(edges: DataFrame, notes: DataFrame, names: DataFrame) -> DataFrame:
    """edges (reporter, target, year, ...) with verdict, by the reporter's notes (reporter, year, text) of its newest year
    and the names (target, name) of targets: terminated if an older edge's target isn't among that year's edges and no
    name of it is in the text; kept if one is; undecidable without a name; null for the others and for reporters without
    a text. Texts and names are compared as they are (see texts.flat); a null year counts as 0, a null or empty text or
    name as none. A name is searched in the texts of its edge's reporter alone, where these lie: edges take
    the names of their targets along, all in one row, and only whether one is found goes on. Edges stay one row each and are
    read once.
    """
    dated = notes.select("reporter", F.coalesce("year", F.lit(0)).alias("_y"), F.nullif("text", F.lit("")).alias("_text"))
    newest = dated.withColumn("_newest", F.max("_y").over(Window.partitionBy("reporter")))
    texts = newest.where("_y = _newest AND _text IS NOT NULL").select("reporter", "_newest", "_text")
    known = names.where(F.coalesce("name", F.lit("")) != "").select("target", "name").distinct().groupBy("target").agg(F.collect_list("name").alias("_names"))
    last = F.max(F.coalesce("year", F.lit(0))).over(Window.partitionBy("reporter", "target"))
    asked = edges.withColumn("_last", last).join(known, "target", "left").alias("e")
    later = texts.where((F.col("reporter") == F.col("e.reporter").outer()) & (F.col("_newest") > F.col("e._last").outer()))
    hits = later.where(F.exists(F.col("e._names").outer(), lambda n: F.contains("_text", n)))
    judged = asked.withColumn("_old", later.exists() & F.col("target").isNotNull()).withColumn("_hit", hits.exists())
    verdict = F.when(~F.col("_old"), None).when(F.col("_names").isNull(), "undecidable").when(F.col("_hit"), "kept").otherwise("terminated")
    return judged.select("reporter", "target", *(c for c in edges.columns if c not in ("reporter", "target")), verdict.alias("verdict"))


def repointed(edges: DataFrame, moves: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """edges with both ends moved by moves (old, new), one row for each (a, b, *keys): of rows that come to be one, an
    unmoved one stays, else the least. A node that moves to itself or nowhere stays; edges from a node to itself that
    moving makes go."""
    to = moves.where("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    moved = edges
    for end in (a, b):
        here = to.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        moved = moved.withColumn(f"_was_{end}", F.col(end)).join(here, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    changed = ~(F.col(f"_was_{a}").eqNullSafe(F.col(a)) & F.col(f"_was_{b}").eqNullSafe(F.col(b)))
    rest = [c for c in edges.columns if c not in (a, b, *keys)]
    best = moved.where(~(changed & F.col(a).eqNullSafe(F.col(b)))).groupBy(a, b, *keys).agg(F.min(F.struct(changed.alias("_c"), f"_was_{a}", f"_was_{b}", *rest)).alias("_s"))
    return best.select(a, b, *keys, *(F.col("_s")[c].alias(c) for c in rest))


def without_stale(rows: DataFrame, touched: DataFrame, source: str, managed: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """rows but those of a managed source whose keys this run hasn't touched; sources managed elsewhere stay."""
    seen = touched.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, list(keys), "left").where(~F.coalesce(F.col(source).isin(*managed), F.lit(False)) | F.col("_seen")).drop("_seen")


#: Beginnings of the names of earnings per share from continuing and discontinued business.
CONTINUING, DISCONTINUED = r"^계속영업\s*기본주당", r"^중단영업\s*기본주당"


def one_basis(items: DataFrame, keys: Sequence[str], name: str, amount: str) -> DataFrame:
    """items without earnings per share of continuing business where the same keys have an amount other than 0 of
    discontinued business: the two aren't of one basis."""
    mixed = items.where(F.col(name).rlike(DISCONTINUED) & (F.col(amount) != 0)).select(*keys).distinct().withColumn("_mixed", F.lit(True))
    return items.join(mixed, list(keys), "left").where(~F.coalesce(F.col(name).rlike(CONTINUING), F.lit(False)) | F.col("_mixed").isNull()).drop("_mixed")


def derived_series(first: Column, second: Column, sign: int) -> Column:
    """first + sign * second, place by place, from unrounded series; null unless both are whole and of one length."""
    whole = lambda s: ~F.exists(s, lambda v: v.isNull())
    return F.when((F.size(first) == F.size(second)) & whole(first) & whole(second), F.zip_with(first, second, lambda x, y: x + sign * y))
