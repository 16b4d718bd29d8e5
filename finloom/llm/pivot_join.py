"""Embedding near-dedup: vectors described by the order of their nearest reference points, met in inverted lists.

1. Reference points (pivots) are vectors of a bounded sample, those left out that link with one chosen before; about the
   root of the number of vectors. Every vector is described by its NEAR nearest pivots, nearest first.
2. Equal vectors of a label are one class. A class is posted to the inverted lists, one for each label and pivot, of its
   first few pivots. Two classes of a list are candidates if their descriptions share SHARED pivots at least; a pair that
   meets in several lists counts in the first.
3. Candidates are verified by the 16-bit codes that are posted, with a bound of what these lose; pairs within the bound of
   the limit are verified by the vectors themselves.
A list that is longer than BLOCK_ROWS is cut into blocks, each pair of which is a task's. Tasks give numbers of links and
the links that join components, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, ShortType, StructField, StructType

from .components import joined
from .storage import dropped, of_batches, of_group, partitions, written

#: Pivots of a description, how many of them two candidates share, and rows of a block.
NEAR, SHARED, BLOCK_ROWS = 8, 2, 8192
#: Pivots at most, by number and by bytes; up to FEW of them a class is posted to three lists, else to four.
MOST_PIVOTS, PIVOT_BYTES, FEW = 32_000, 64 << 20, 2_048
#: Postings of short lists that are handed to a task together, on average.
POSTINGS = 20_000
#: Pairs that are compared at once.
PAIRS = 1 << 20

FOUND = "a long, b long, n long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size; rows of zeros stay."""
    largest = np.abs(vectors).max(1, keepdims=True) if vectors.size else np.ones((len(vectors), 1))
    scaled = vectors / np.where(largest > 0, largest, 1)
    length = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return scaled / np.where(length > 0, length, 1)


def thinned(sample: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """The rows of sample, in order, but for those with that cosine to a row kept before; at most so many."""
    kept = np.zeros((0, sample.shape[1]))
    for at in range(0, len(sample), 256):
        block = sample[at : at + 256]
        block = block[(block @ kept.T < cosine).all(1)] if len(kept) else block
        own, stays = block @ block.T, np.ones(len(block), bool)
        for i in range(len(block)):
            stays[i] = not (own[i, :i][stays[:i]] >= cosine).any()
        kept = np.concatenate([kept, block[stays]])
        if len(kept) >= most:
            break
    return kept[:most]


def described(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: 16-bit codes, their scale, the length of what the code loses, and the nearest pivots, in order."""
    scale = np.abs(vectors).max(1) / 32_767
    codes = np.rint(vectors / scale[:, None]).astype(np.int16)
    lost = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(1))
    near = min(NEAR, len(pivots))
    alike = vectors @ pivots.T
    some = np.argpartition(-alike, near - 1, 1)[:, :near] if near < len(pivots) else np.tile(np.arange(near), (len(vectors), 1))
    order = np.lexsort((some, -np.take_along_axis(alike, some, 1)))
    return codes, scale, lost, np.take_along_axis(some, order, 1)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number of each one's component, of n numbers and the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


class _List:
    """The classes of a list, or of a block of it."""

    def __init__(self, c: np.ndarray, n: np.ndarray, vectors: np.ndarray, lost: np.ndarray, near: np.ndarray):
        self.c, self.n, self.vectors, self.lost, self.near = c, n, vectors, lost, near

    def bits(self, pivot: int) -> np.ndarray:
        """A bit for each pivot of the descriptions but this one; some share a bit."""
        return np.bitwise_or.reduce(np.where(self.near == pivot, np.uint64(0), np.uint64(1) << (self.near & 63).astype(np.uint64)), 1)

    def __getitem__(self, rows) -> _List:
        return _List(self.c[rows], self.n[rows], self.vectors[rows], self.lost[rows], self.near[rows])


def compared(x: _List, y: _List, within: bool, pivot: int, posts: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of the pairs of x and y that are linked, and of those that the codes can't tell; within: x is y."""
    need = min(SHARED, x.near.shape[1])
    out: list[list[np.ndarray]] = [[], [], [], []]
    step = max(1, PAIRS // max(1, len(y.c)))
    own_bits, other = (x.bits(pivot), y.bits(pivot)) if need > 1 else (np.ones(len(x.c), np.uint64), np.ones(len(y.c), np.uint64))
    for low in range(0, len(x.c), step):
        high = min(low + step, len(x.c))
        maybe = (own_bits[low:high, None] & other[None]) != 0
        if within:
            maybe &= np.arange(low, high)[:, None] < np.arange(len(y.c))[None]
        i, j = np.nonzero(maybe)
        for at in range(0, len(i), PAIRS // 8):
            p, q = i[at : at + PAIRS // 8] + low, j[at : at + PAIRS // 8]
            shared = np.zeros(len(p), np.int64)
            first = np.full(len(p), np.iinfo(np.int64).max)
            for k in range(x.near.shape[1]):
                mine = x.near[p, k]
                same = (y.near[q] == mine[:, None])
                shared += same.any(1)
                if k < posts:
                    first = np.minimum(first, np.where(same[:, :posts].any(1), mine, first))
            own = (shared >= need) & (first == pivot)
            p, q = p[own], q[own]
            alike = (x.vectors[p] * y.vectors[q]).sum(1)
            lost = x.lost[p] + y.lost[q]
            bound = lost * (1 + lost) + 1e-9
            sure, open_ = alike >= cosine + bound, np.abs(alike - cosine) < bound
            for k, v in enumerate((p[sure], q[sure], p[open_], q[open_])):
                out[k].append(v)
    none = [np.zeros(0, np.int64)]
    i, j, p, q = (np.concatenate(v or none) for v in out)
    return i, j, p, q


def _rows(a, b, n) -> pa.Table:
    return pa.table([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])


def _of_lists(posts: int, cosine: float):
    """Of a table of postings: (a, null, n) for n links of class a, (a, b, null) for links that join components, (a, b, 0)
    for pairs still to be verified."""

    def of_table(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number = lambda name: table.column(name).to_numpy()
        label = table.column("label").combine_chunks().dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
        size, pivot, i, j = (number(c) for c in ("dims", "pivot", "i", "j"))
        order = np.lexsort((j, i, pivot, size, label))
        keys = np.stack([label, size, pivot, i, j], 1)[order]
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
        codes, near = table.column("code").to_pylist(), table.column("near").to_pylist()
        c, n, side, scale, lost = (number(x) for x in ("c", "n", "side", "scale", "lost"))
        out = [_rows([], [], [])]
        for a, b in zip(edges, edges[1:], strict=False):
            rows = order[a:b]
            if b - a < 2:
                continue
            raw = np.frombuffer(b"".join(codes[r] for r in rows.tolist()), "<i2").reshape(len(rows), -1)
            whole = _List(c[rows], n[rows], raw * scale[rows][:, None], lost[rows], np.array([near[r] for r in rows.tolist()], np.int64))
            left, right = np.flatnonzero(side[rows] <= 0), np.flatnonzero(side[rows] != 0)
            within = bool((side[rows] < 0).all())
            x, y = (whole, whole) if within else (whole[left], whole[right])
            p, q, r, s = compared(x, y, within, int(keys[a, 2]), posts, cosine)
            if not within:
                p, q, r, s = left[p], right[q], left[r], right[s]
            links = np.bincount(p, whole.n[q], len(rows)) + np.bincount(q, whole.n[p], len(rows))
            root, held = roots(len(rows), p, q), np.flatnonzero(links)
            joins = np.flatnonzero(root != np.arange(len(rows)))
            out.append(_rows(whole.c[held], [None] * len(held), links[held].astype(np.int64)))
            out.append(_rows(whole.c[joins], whole.c[root[joins]], [None] * len(joins)))
            out.append(_rows(whole.c[r], whole.c[s], np.zeros(len(r), np.int64)))
        return pa.concat_tables(out)

    return of_table


def _finite(column: Column) -> Column:
    """Whether an array has numbers, all of them finite, and not only zeros."""
    return (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)


def link_vectors(vectors: DataFrame, cosine: float = 0.93, pivots: int | None = None, posts: int | None = None, vector: str = "embedding", label: str = "label", seed: int = 11) -> DataFrame:
    """Of each row of vectors (vec_id, a label, an array of numbers): vec_id, n_links (other rows linked directly),
    component_id (the smallest vec_id reachable by links, itself included) and kept (vec_id = component_id, null = null).

    Two rows link if their labels are equal, not null, and the cosine of their vectors is that at least; the index finds
    nearly all such pairs (recall: README) and links none below. Vectors that are null, empty, all zeros, or hold null or
    numbers that aren't finite link with nothing, nor do vectors of different lengths. Repeated rows link with each other; a
    component whose ids are all null has a null component_id. An empty table gives no rows. Other columns aren't read.
    pivots: how many at most; by default the root of the number of vectors, 64 at least, MOST_PIVOTS and PIVOT_BYTES at
    most. They come from a sample of twice as many rows by a hash, which is the only part of the table on the driver.
    Work: descriptions and 16-bit codes are shuffled once to make classes of equal vectors, and once to their three (four)
    lists; links are counted where they are found.
    """
    spark = vectors.sparkSession
    column = F.col(vector).cast("array<double>")
    can = F.col(label).isNotNull() & column.isNotNull() & _finite(column)
    key = [F.when(can, F.xxhash64(F.lit(k), F.col(label), column)).alias(f"k{k}") for k in (1, 2)]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), column.alias("vector"), *key)
    valid = rows.where("k1 IS NOT NULL")
    held = valid.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not held["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    most = min(pivots or max(64, round(held["n"] ** 0.5)), MOST_PIVOTS, max(1, PIVOT_BYTES // (8 * held["dims"])))
    sample = valid.select(F.xxhash64(F.lit(seed), "k1").alias("h"), "k2", "vector").orderBy("h", "k2").limit(2 * most).select("vector").collect()
    chosen = np.zeros((len(sample), held["dims"]))
    for i, r in enumerate(sample):
        chosen[i, : len(r["vector"])] = unit(np.array([r["vector"]]))[0]
    chosen = thinned(chosen, most, cosine)
    posts = posts or (3 if len(chosen) <= FEW else 4)
    given = spark.sparkContext.broadcast(chosen)
    fields = [StructField("label", vectors.schema[label].dataType), StructField("k1", LongType()), StructField("k2", LongType()), StructField("vec_id", LongType()), StructField("dims", IntegerType()), StructField("code", BinaryType()), StructField("scale", DoubleType()), StructField("lost", DoubleType()), StructField("near", ArrayType(ShortType()))]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
            first = np.cumsum(sizes) - sizes
            out: dict[str, list] = {"code": [None] * len(sizes), "scale": [0.0] * len(sizes), "lost": [0.0] * len(sizes), "near": [None] * len(sizes)}
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                # longer pivots are cut: whatever points they are then, all vectors of this length have the same
                for part in np.array_split(at, -(-len(at) // 512)):
                    codes, scale, lost, near = described(unit(flat[first[part][:, None] + np.arange(size)]), unit(given.value[:, :size]))
                    for k, r in enumerate(part.tolist()):
                        out["code"][r], out["scale"][r], out["lost"][r], out["near"][r] = codes[k].tobytes(), scale[k], lost[k], near[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(sizes, pa.int32()), pa.array(out["code"], pa.binary()), pa.array(out["scale"]), pa.array(out["lost"]), pa.array(out["near"], pa.list_(pa.int16()))], [f.name for f in fields])

    slim = valid.select("label", "k1", "k2", "vector", "vec_id").mapInArrow(of_batches(describe), StructType(fields))
    same = F.struct("label", "dims", "code", "scale", "lost", "near")
    classes = slim.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first(same).alias("same"))
    classes = written(classes.select("k1", "k2", "n", "low", "same.*").withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    found = written(_postings(classes, posts).groupBy("gid").applyInArrow(of_group(_of_lists(posts, cosine)), FOUND), "vector-links")
    counts, edges = found.where("b IS NULL").select("a", "n"), found.where("n IS NULL").select("a", "b")
    unsure = found.where("n = 0 AND b IS NOT NULL").select("a", "b")
    if not unsure.isEmpty():
        sure = written(_exact(unsure, classes, valid, cosine), "vector-links")
        size = classes.select(F.col("c").alias("b"), "n")
        both = sure.union(sure.select("b", "a"))
        counts, edges = counts.unionByName(both.join(size, "b").select("a", "n")), edges.unionByName(sure)
    totals = counts.groupBy("a").agg(F.sum("n").alias("links"))
    labels = joined(written(classes.select(F.col("c").alias("v"), F.col("c").alias("label")), "labels"), edges)
    lows = labels.join(classes.select(F.col("c").alias("v"), "low"), "v")
    lows = lows.join(lows.groupBy("label").agg(F.min("low").alias("component")), "label").select(F.col("v").alias("c"), "component")
    known = classes.select("c", "k1", "k2", "n").join(lows, "c").join(totals.withColumnRenamed("a", "c"), "c", "left")
    known = written(known.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "vector-components")
    dropped(classes, labels)
    is_known = F.col("n_links").isNotNull()
    out = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(is_known, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _postings(classes: DataFrame, posts: int) -> DataFrame:
    """The classes in their lists, with gid, a task's share: some short lists, or two blocks (i, j) of a long one (side 0 and
    1; -1 where both are one)."""
    key = ["label", "dims", "pivot"]
    posted = classes.select("label", "dims", F.explode(F.slice("near", 1, posts)).alias("pivot"), "c", "n", "code", "scale", "lost", "near")
    sizes = classes.select("label", "dims", F.explode(F.slice("near", 1, posts)).alias("pivot")).groupBy(*key).count()
    long_ = sizes.where(F.col("count") > BLOCK_ROWS).select(*key, F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    total = classes.count() * posts
    tasks = max(partitions(classes.sparkSession), -(-total // POSTINGS))
    cut = posted.join(long_, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    gid = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*key), F.lit(tasks))).otherwise(F.xxhash64(*key, i, j))
    return cut.select(gid.alias("gid"), *key, i.alias("i"), j.alias("j"), side.alias("side"), "c", "n", "code", "scale", "lost", "near")


def _exact(pairs: DataFrame, classes: DataFrame, valid: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of classes whose vectors have that cosine, in double precision."""
    named = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    own = classes.join(named, "c").select("c", "k1", "k2")
    held = written(valid.join(own, ["k1", "k2"]).select("c", "vector").dropDuplicates(["c"]), "vectors")
    of = lambda side, name: held.select(F.col("c").alias(side), F.col("vector").alias(name))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i in range(batch.num_rows) if float((unit(np.array([batch.column(2)[i].as_py()])) * unit(np.array([batch.column(3)[i].as_py()]))).sum()) >= cosine]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], ["a", "b"])

    return pairs.distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(of_batches(verified), "a long, b long")
