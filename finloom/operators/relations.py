"""Relations between firms: classes, currency, topology and documents. Silver is a function of bronze: nothing is updated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import spoken_name
from ..functions.numbers import ownership
from ..functions.texts import normal_name, short_latin_name
from .keyed import latest_per_key

#: Shares of common stock count before unknown, these before preferred.
STOCK_RANK = (("common", 0), ("unknown", 1), ("preferred", 2))


def stock_rank(kind: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in STOCK_RANK:
        out = out.when(kind == name, rank)
    return out.otherwise(1)


def reduced(raw: DataFrame, keys: Sequence[str], kind: str, share: str, arrival: str) -> DataFrame:
    """One row for each natural key: by rank of the stock, then the higher share, then the later arrival."""
    return latest_per_key(raw, keys, [stock_rank(F.col(kind)), F.col(share).desc_nulls_last(), F.col(arrival).desc()])


def classified(edges: DataFrame, share: str) -> DataFrame:
    """edges with relation (by share) and status: active, or ended without a class."""
    return edges.withColumn("relation", ownership(share)).withColumn("status", F.when(F.col("relation").isNull(), "ended").otherwise("active"))


def current(edges: DataFrame, reporter: Column, lineage: str, year: str, keys: Sequence[str], share: str, tie: str, exempt: Column) -> DataFrame:
    """Active edges that stand: the latest of each key and lineage (the higher share in a year), of the newest year its
    reporter has in the lineage. Years and latest rows are taken of all statuses before the active ones are picked;
    rows that exempt marks keep older years."""
    newest = F.max(year).over(Window.partitionBy("_reporter", lineage))
    dated = edges.withColumn("_reporter", reporter).withColumn("_newest", newest)
    last = latest_per_key(dated, [*keys, lineage], [F.col(year).desc(), F.coalesce(share, F.lit(0.0)).desc(), F.col(tie)])
    return last.where((F.col("status") == "active") & (exempt | (F.col(year) == F.col("_newest")))).drop("_reporter", "_newest")


def fresh(edges: DataFrame, today: Column, window_years: int = 1) -> DataFrame:
    """Active edges that are fresh: notes of their reporter's newest year with an active one, contracts until their end
    (without one like prose), prose of this year or window_years before, others always. edges: source_kind, src, dst,
    edge_type, year, valid_until, status."""
    own = F.when(F.col("edge_type").isin("customer", "capital_out"), F.col("src")).otherwise(F.col("dst"))
    dated = edges.where("status = 'active'").withColumn("_self", own)
    newest = F.max(F.when(F.col("source_kind") == "note", F.col("year"))).over(Window.partitionBy("_self"))
    recent = F.col("year") >= F.year(today) - window_years
    contract = F.when(F.col("valid_until").isNotNull(), F.col("valid_until") >= today).otherwise(recent)
    keep = F.when(F.col("source_kind") == "note", F.col("year") == F.col("_newest")).when(F.col("source_kind") == "contract", contract).when(F.col("source_kind") == "prose", recent).otherwise(True)
    return dated.withColumn("_newest", newest).where(keep).drop("_self", "_newest")


def stars(members: DataFrame, group: str, node: str, cap: str) -> DataFrame:
    """group, hub and member: each group's hub (the largest cap, then the least node) to its others. One row a member,
    where a clique has the square of them."""
    hubs = members.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(F.col(node), F.struct(-F.coalesce(F.col(cap), F.lit(float("-inf"))), F.col(node))).alias("hub"))
    return members.join(hubs, group).where(F.col(node) != F.col("hub")).select(group, "hub", F.col(node).alias("member"))


def directed_both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, other and direction of each edge from either end; an edge from a node to itself once, as out."""
    out = F.struct(F.col(a).alias("node"), F.col(b).alias("other"), F.lit("out").alias("direction"))
    back = F.struct(F.col(b).alias("node"), F.col(a).alias("other"), F.lit("in").alias("direction"))
    return edges.select("*", F.inline(F.when(F.col(a) == F.col(b), F.array(out)).otherwise(F.array(out, back))))


def with_incoming(edges: DataFrame, a: str, b: str) -> DataFrame:
    """a and b of edges, with each reversed edge whose pair has none that way, and incoming for these."""
    there = edges.select(a, b).distinct()
    back = there.select(F.col(b).alias(a), F.col(a).alias(b)).join(there, [a, b], "left_anti")
    return there.withColumn("incoming", F.lit(False)).unionByName(back.withColumn("incoming", F.lit(True)))


def ego_documents(edges: DataFrame, a: str, b: str, value: str, most: int = 60) -> DataFrame:
    """node, degree, and neighbours: a list of (other, direction, value), the largest values first, then by name, most at
    most. The list is cut by rank before it is gathered, so a hub's document is bounded. Edges of the same ends are one
    before they are seen from both."""
    ends = directed_both_ways(edges.groupBy(a, b).agg(F.max(value).alias("value")), a, b).select("node", "other", "direction", "value")
    w = Window.partitionBy("node").orderBy(F.col("value").desc_nulls_last(), "other", "direction")
    kept = ends.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    lists = kept.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_i", "other", "direction", "value"))).alias("_l"))
    lists = lists.select("node", F.transform("_l", lambda x: F.struct(x["other"].alias("other"), x["direction"].alias("direction"), x["value"].alias("value"))).alias("neighbours"))
    # counted by value, so that both branches ask for the same columns and share what is shuffled for ends
    degree = (F.count_if(F.col("value").isNull()) + F.count_if(F.col("value").isNotNull())).alias("degree")
    return ends.groupBy("node").agg(degree).join(lists, "node")


def name_book(registry: DataFrame, name: str, code: str) -> DataFrame:
    """name (as it is looked up), code and spoken: of each firm its name, of several with one the largest code; and what it
    is called when its Latin letters are spelled, unless that is another firm's name, or more than one firm is called so."""
    listed = registry.where(F.col(code).isNotNull()).select(F.col(name).alias("_n"), F.col(code).alias("code"))
    real = listed.select(normal_name("_n").alias("name"), "code").where("name <> ''").groupBy("name").agg(F.max("code").alias("code")).withColumn("spoken", F.lit(False))
    called = listed.select(normal_name(spoken_name("_n")).alias("name"), "code").where("name <> ''")
    owned = called.groupBy("name").agg(F.min("code").alias("code"), F.max("code").alias("_last")).where("code = _last").drop("_last")
    return real.unionByName(owned.join(real, "name", "left_anti").withColumn("spoken", F.lit(True)))


def resolved(names: DataFrame, name: str, book: DataFrame) -> DataFrame:
    """names with code and queued: a name's code in the book; a name too short to link by gets that of a firm of just this
    name alone, never of one that is called so, else none and is queued like every name without a code."""
    keyed = names.withColumn("_k", normal_name(name)).withColumn("_short", short_latin_name(name))
    met = keyed.join(book.select(F.col("name").alias("_b"), "code", "spoken"), F.col("_k") == F.col("_b"), "left")
    sure = F.when(~(F.col("_short") & F.coalesce("spoken", F.lit(False))), F.col("code"))
    return met.withColumn("code", sure).withColumn("queued", F.col("code").isNull() & (F.coalesce("_k", F.lit("")) != "")).drop("_k", "_b", "_short", "spoken")


def linked(names: DataFrame, name: str, sources: Sequence[DataFrame]) -> DataFrame:
    """names with code: of the first of sources (name, code) that has the name, the largest code there."""
    parts = [s.groupBy("name").agg(F.max("code").alias("code")).withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    book = whole.groupBy("name").agg(F.min_by("code", "_p").alias("code")).withColumnRenamed("name", "_name")
    return names.join(book, F.col(name) == F.col("_name"), "left").drop("_name")


def unlinked(links: DataFrame, surface: str, sample: str) -> DataFrame:
    """surface, freq and sample (the least) of the names without a code."""
    return links.where(F.col("code").isNull() & F.col(surface).isNotNull()).groupBy(surface).agg(F.count("*").alias("freq"), F.min(sample).alias("sample"))
