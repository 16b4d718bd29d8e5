"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a grouped prefix join.

1. Chunks of documents exchange their shingles (packed.py): each learns how many documents hold each of its own. A
   document fewer of whose shingles are shared than a link needs is linked with nothing. Of any other, the prefix is
   its rarest shared shingles, so many that two linked documents have one in common.
2. Documents with equal sets become one class; classes with the same prefix and size one group.
3. In a few rounds, groups are compared with one leader of each prefix shingle (and of their size), members with one of
   their group. The first leader is the group whose shingles most documents hold: that of the original, where others
   are edits of it. Linked classes become one component.
4. The rest: all pairs of groups that pass the filters of size and position are expanded to members and verified, but
   for members that are in one component already: first one pair for each two components, then what those leave. So no
   link between components is lost, and a large group of near copies isn't paired with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import joined
from .packed import ROWS, answered, chunked, codes, found, layout, received, send
from .storage import dropped, of_batches, of_group, of_groups, written
from .words import shingle_sets

SETS = "doc_id long, n int, v binary, common long, shared int, prefix array<long>, shingles binary"

#: Rounds in which groups are compared with leaders alone. More rounds leave less to the last step; none is needed for
#: the result.
LEADER_ROUNDS = 3


def _need(n: int, percent: int) -> int:
    """The fewest shingles that a set of n has in common with one it is linked with."""
    return -(-percent * n // 100)


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set) and, where links are possible, v (a hash of the set), common (how many documents hold
    a shingle of it on average), shared (how many shingles other documents hold), with prefix and shingles in one
    document at least of each v of a chunk."""
    chunks, parts = layout(docs)
    dealt = chunked(docs, chunks).groupBy("chunk")

    def own(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(table.column("text"), words)]), return_counts=True)
        return send(table.column("chunk")[0].as_py(), keys, counts.astype(np.uint32), parts, True)

    def totals(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.bincount(at, counts).astype(np.int64)
        told = np.flatnonzero(total[at] > 1)
        return told, np.minimum(total[at[told]], 2**32 - 1).astype(np.uint32)

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, held_by = received(answers, np.uint32, True)
        rows: dict[str, list] = {"n": [], "v": [], "common": [], "shared": [], "prefix": [], "shingles": []}
        seen: set[bytes] = set()
        for shingles in shingle_sets(table.column("text"), words):
            n, v, common, prefix, raw = len(shingles), None, None, None, None
            shared, at = found(known, codes(shingles, parts))
            spare = int(shared.sum()) - _need(n, percent)
            if n and spare >= 0:
                raw, common = shingles.tobytes(), int(held_by[at[shared]].sum(dtype=np.int64)) // n
                v = hashlib.blake2b(raw, digest_size=16).digest()
                if v in seen:
                    raw = None
                else:
                    seen.add(v)
                    rare, often = shingles[shared], held_by[at[shared]]
                    prefix = rare[np.lexsort((rare, often))[: spare + 1]].view(np.int64)
            for name, value in (("n", n), ("v", v), ("common", common), ("shared", spare + _need(n, percent)), ("prefix", prefix), ("shingles", raw)):
                rows[name].append(value)
        doc_id = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        return pa.table([doc_id, pa.array(rows["n"], pa.int32()), pa.array(rows["v"], pa.binary()), pa.array(rows["common"], pa.int64()), pa.array(rows["shared"], pa.int32()), pa.array(rows["prefix"], pa.list_(pa.int64())), pa.array(rows["shingles"], pa.binary())], names=["doc_id", "n", "v", "common", "shared", "prefix", "shingles"])

    shared = answered(dealt.applyInArrow(of_group(own), ROWS), np.dtype(np.uint32), True, totals)
    return dealt.cogroup(shared.groupBy("chunk")).applyInArrow(of_groups(prefixes), SETS)


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""

    def alike(batches):
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = int(found(y, x)[0].sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], ["a", "b"])

    of = lambda side, name: classes.select(F.col("v").alias(side), F.col("shingles").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(of_batches(alike), "a binary, b binary")


def link_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every whole text.

    Two documents link when 100 * common shingles >= percent * shingles of both together. A text of fewer words than a
    shingle is one shingle; null, empty and blank texts have none and link with nothing. A-Z count as a-z. Repeated
    rows link like copies. A component whose ids are all null has a null component_id. A very long text lies whole in
    one chunk. Other columns aren't read. Shingles are compared by 64-bit hashes, sets by 128 bits; groups of one
    64-bit number are taken together, whatever their prefixes.
    A bucket that many groups share is split by Spark's adaptive skew join; what is made of it are its groups times
    leaders, then only pairs of different components.
    """
    table = written(shingle_table(docs, words, percent), "shingles")
    own = table.where("shingles IS NOT NULL").select("v", "n", "common", "shared", "prefix", "shingles").dropDuplicates(["v"])
    classes = written(own.withColumn("g", F.xxhash64("n", "prefix")), "classes")
    members = written(classes.select("v", "n", "g", "common", "shared"), "members")
    heads = members.groupBy("g").agg(F.max("n").alias("n"), F.max("common").alias("common"), F.max_by("v", F.struct("common", "v")).alias("v"))
    # rest: the shared shingles after one of the prefix, which bound what two documents that meet there have in common
    tokens = classes.dropDuplicates(["g", "n", "prefix"]).select("g", "n", "common", F.posexplode("prefix").alias("place", "token"), "shared")
    tokens = written(tokens.select("g", "n", "common", "token", (F.col("shared") - F.col("place") - 1).alias("rest")), "prefixes")
    labels = written(members.select("v", F.col("v").alias("label")), "labels")

    def possible(n, rest, m, other) -> Column:
        """Whether sets of sizes n and m that first meet at a shingle can be linked."""
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((1 + F.least(rest, other)) * (100 + percent) >= percent * (n + m))

    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)))
    places = tokens.withColumn("band", F.explode(F.array(band, band + 1)))  # sizes that may be linked share a band
    for r in range(leader_rounds):
        first = (lambda key: F.struct(-F.col("common"), F.col(key))) if r == 0 else (lambda key, r=r: F.struct(F.xxhash64(F.lit(r), key), F.col(key)))
        leaders = places.groupBy("token", "band").agg(F.count("*").alias("size"), F.min(F.struct(first("g").alias("o"), "g", "n", "rest")).alias("l")).where("size > 1").select("token", "band", F.col("l.g").alias("h"), F.col("l.n").alias("m"), F.col("l.rest").alias("other"))
        met = places.join(leaders, ["token", "band"]).where((F.col("g") != F.col("h")) & possible(F.col("n"), F.col("rest"), F.col("m"), F.col("other")))
        groups = met.select("g", "h").distinct()
        across = groups.join(heads.select("g", F.col("v").alias("a")), "g").join(heads.select(F.col("g").alias("h"), F.col("v").alias("b")), "h").select("a", "b")
        chosen = members.groupBy("g").agg(F.count("*").alias("size"), F.min_by("v", first("v")).alias("a")).where("size > 1").select("g", "a")
        inside = members.join(chosen, "g").select("a", F.col("v").alias("b"))
        pairs = across.union(inside).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = _linked(labels, _verified(_apart(pairs, labels) if r else pairs, classes, percent))
    for whole in (False, True):
        placed, pairs = _remaining(members, tokens, labels, possible, whole)
        labels = _linked(labels, _verified(pairs, classes, percent))
        dropped(placed)
    dropped(classes, members, tokens)
    ids = table.where("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("low"))
    lows = labels.join(ids, "v")
    lows = lows.join(lows.groupBy("label").agg(F.min("low").alias("component")), "label").select("v", "component")
    out = table.select("doc_id", "n", "v").join(lows, "v", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _linked(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """labels after the links of pairs, which are written first."""
    edges = written(pairs, "edges")
    out = joined(labels, edges)
    dropped(edges)
    return out


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose classes have different labels."""
    of = lambda side, name: labels.select(F.col("v").alias(side), F.col("label").alias(name))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select("a", "b")


def _remaining(members: DataFrame, tokens: DataFrame, labels: DataFrame, possible: Callable[..., Column], whole: bool) -> tuple[DataFrame, DataFrame]:
    """A written table, and from it pairs of classes that a link may join and no label does; unless whole, one of each
    two labels.

    Of what meets in a bucket (a prefix shingle, or a group), all but the largest component are paired with all others.
    """
    # two labels that are compared here are alike in 64 bits by a chance that needs no more of them
    placed = written(members.join(labels.select("v", F.xxhash64("label").alias("label")), "v"), "placed")
    kinds = placed.select("g", "label").distinct()
    spots = tokens.join(kinds, "g")

    def crossing(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(rows outside the largest component of their bucket, all rows), of buckets with several components."""
        sizes = rows.groupBy(key, "label").agg(F.count("*").alias("size"))
        largest = sizes.groupBy(key).agg(F.count("*").alias("kinds"), F.max_by("label", F.struct("size", "label")).alias("largest")).where("kinds > 1").select(key, "largest")
        mixed = rows.join(largest, key)
        return mixed.where("label <> largest"), mixed

    few, many = crossing(spots, "token")
    far = many.select("token", F.col("g").alias("h"), F.col("n").alias("m"), F.col("rest").alias("after"), F.col("label").alias("other"))
    meet = (few["token"] == far["token"]) & (few["label"] != far["other"]) & (few["g"] != far["h"]) & possible(few["n"], few["rest"], far["m"], far["after"])
    groups = few.join(far, meet).select("g", "label", "h", "other").distinct()
    if not whole:
        low, high = F.least("label", "other").alias("x"), F.greatest("label", "other").alias("y")
        ends = F.when(F.col("label") < F.col("other"), F.struct("g", "label", "h", "other")).otherwise(F.struct(F.col("h").alias("g"), F.col("other").alias("label"), F.col("g").alias("h"), F.col("label").alias("other")))
        groups = groups.groupBy(low, high).agg(F.min(ends).alias("e")).select("e.*")
    each = placed if whole else placed.groupBy("g", "label").agg(F.max_by("v", F.struct("common", "v")).alias("v"))
    left = each.select("g", "label", F.col("v").alias("a"))
    right = each.select(F.col("g").alias("h"), F.col("label").alias("other"), F.col("v").alias("b"))
    across = groups.join(left, ["g", "label"]).join(right, ["h", "other"]).select("a", "b")
    few, many = crossing(placed if whole else each, "g")
    inside = few.select("g", "label", F.col("v").alias("a")).join(many.select("g", F.col("label").alias("other"), F.col("v").alias("b")), "g").where("label <> other").select("a", "b")
    return placed, across.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
