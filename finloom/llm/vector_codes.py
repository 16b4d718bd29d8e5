"""Vector code compression: product codes by Lloyd's rounds that filter codebooks down kd-trees.

Vectors of integers are cut into equal parts, each with a codebook. Every partition packs its vectors into chunks and
builds a kd-tree over each part of a chunk once; the trees, with the box, sum and count of every node, are written and
serve all rounds. A round goes down a tree level by level: of a node's candidate entries, the one nearest to the middle of
its box rules out those that are farther from every corner of the box. Where one entry is left, the node's whole subtree
is assigned to it by its cached sum and count; below the last level, points are compared with the entries left.

Integers stay exact: float64 holds them where 4 * dimensions * largest^2 is below 2^53, else int64 is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .storage import of_batches, written

#: Vectors of a chunk, and points below which a node isn't split.
CHUNK_ROWS, LEAF = 8192, 16


def levels(n: int) -> list[np.ndarray]:
    """Where the nodes of each level of a tree of n points begin and end; each node is halved."""
    out = [np.array([0, n])]
    while out[-1][1] - out[-1][0] > LEAF:
        edges = out[-1]
        finer = np.empty(2 * len(edges) - 1, np.int64)
        finer[::2], finer[1::2] = edges, (edges[:-1] + edges[1:] + 1) // 2
        out.append(finer)
    return out


class Tree:
    """A kd-tree over points: `order` of the points, and of each level's nodes the box (low, high) and the sum."""

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray):
        self.points, self.order, self.low, self.high, self.total = points, order, low, high, total
        self.levels = levels(len(points))

    @classmethod
    def of(cls, points: np.ndarray) -> Tree:
        order, boxes = np.arange(len(points)), []
        for edges in levels(len(points)):
            here, node = points[order], np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            low, high = np.minimum.reduceat(here, edges[:-1]), np.maximum.reduceat(here, edges[:-1])
            boxes.append((low, high, np.add.reduceat(here, edges[:-1], dtype=np.int64)))
            if len(edges) - 1 < len(levels(len(points))[-1]) - 1:  # the widest side is halved at its median
                side = (high - low).argmax(1)
                order = order[np.lexsort((here[np.arange(len(here)), side[node]], node))]
        return cls(points[order], order, *(np.concatenate(b) for b in zip(*boxes, strict=True)))

    def packed(self) -> list[bytes]:
        return [self.points.astype("<i4").tobytes(), self.order.astype("<i4").tobytes(), self.low.astype("<i4").tobytes(), self.high.astype("<i4").tobytes(), self.total.astype("<i8").tobytes()]

    @classmethod
    def unpacked(cls, raw: Sequence[bytes], size: int) -> Tree:
        points, low, high, total = (np.frombuffer(raw[i], "<i8" if i == 4 else "<i4").reshape(-1, size) for i in (0, 2, 3, 4))
        return cls(points, np.frombuffer(raw[1], "<i4"), low, high, total)


class Filtered:
    """What a codebook's entries are given of a tree: nodes (entry, sum, count) as a whole, and single points (entry,
    squared distance)."""

    def __init__(self, tree: Tree, book: np.ndarray, kind: type):
        book = book.astype(kind)
        norm = (book * book).sum(1)
        self.entry = np.zeros(len(tree.points), np.int64)
        self.sums, self.counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        self.whole = 0  # points assigned with a subtree
        node, base = np.zeros(1, np.int64), 0
        left = np.ones((1, len(book)), bool)
        for edges in tree.levels:
            low, high = tree.low[base + node].astype(kind), tree.high[base + node].astype(kind)
            # nearest to the middle of the box, twice which is low + high; any candidate would do
            far = 2.0 * norm - 2.0 * ((low + high).astype(np.float64) @ book.T.astype(np.float64))
            best = np.where(left, far, np.inf).argmin(1)
            row, z = np.nonzero(left)
            side = book[z] - book[best[row]]
            corner = np.where(side > 0, high[row], low[row])
            least = norm[z] - norm[best[row]] - 2 * (corner * side).sum(1)  # how much farther z is, at least
            out = (least > 0) | ((least == 0) & (z > best[row]))
            left[row[out], z[out]] = False
            single = left.sum(1) == 1
            for i in np.flatnonzero(single).tolist():
                a, b = edges[node[i]], edges[node[i] + 1]
                self.entry[a:b] = best[i]
                self.whole += b - a
            np.add.at(self.sums, best[single], tree.total[base + node[single]])
            np.add.at(self.counts, best[single], np.diff(edges)[node[single]])
            node, left, base = node[~single], left[~single], base + len(edges) - 1
            if edges is not tree.levels[-1]:
                node, left = np.stack([2 * node, 2 * node + 1], 1).reshape(-1), np.repeat(left, 2, 0)
        edges = tree.levels[-1]
        size = np.diff(edges)[node]
        at = np.repeat(edges[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        points = tree.points[at].astype(kind)
        far = np.where(np.repeat(left, size, 0), norm - 2 * (points @ book.T), np.iinfo(np.int64).max if kind is np.int64 else np.inf)
        self.entry[at] = found = far.argmin(1)
        np.add.at(self.sums, found, tree.points[at].astype(np.int64))
        np.add.at(self.counts, found, 1)


class Codes:
    """vectors: of each kept row vec_id, the columns carried, code (two hex digits for each part) and error; books: the final
    codebooks, an array of parts x entries x components."""

    def __init__(self, vectors: DataFrame, books: np.ndarray):
        self.vectors, self.books = vectors, books

    def digest(self) -> str:
        """sha256 of all entries' components by part, entry and position, as decimals with commas between."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _kept(column: Column, parts: int, most: float) -> Column:
    """Whether a vector has components, in equal parts, all of them finite and within most."""
    return (F.size(column) > 0) & (F.size(column) % parts == 0) & F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < most))


def compress_vectors(vectors: DataFrame, carry: Sequence[str] = (), vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    """Codes of the rows of vectors (vec_id, an array of numbers, columns to carry along).

    Each component x becomes floor(scale * x). A part's codebook starts as that part of the `entries` smallest vec_ids
    (at most 256, as a code has two digits), null last, ties by vector; fewer rows make fewer entries. Each round assigns
    every part to its nearest entry, ties to the lower index, and moves each entry to the floor of its parts' mean; unused
    ones stay. Rows are dropped whose vector is null, empty, of another length than the first kept row's or of one that
    isn't a multiple of parts, or holds a null or a number that isn't finite or so large (2^27 / scale and more, for up to
    128 dimensions) that a squared distance may not fit a long. Repeated rows and ids are each coded. An empty table gives no rows.
    Work: the input is read twice (first rows; trees). Trees are written once; a round reads them and brings a row for
    each component of the codebooks to the driver, however many vectors there are.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    spark, column = vectors.sparkSession, F.col(vector)
    ids = F.col("vec_id").cast("long")
    rows = vectors.where(column.isNotNull()).select(ids.alias("vec_id"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)), column.cast("array<double>").alias("vector"))
    rows = rows.where(_kept(F.col("vector"), parts, 2.0**27 / scale))

    def smallest(df: DataFrame) -> list[list[float]]:
        return [r["vector"] for r in df.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]

    first = smallest(rows)
    size = len(first[0]) if first else parts
    if any(len(v) != size for v in first):
        first = smallest(rows.where(F.size("vector") == size))
    rows = rows.where(F.size("vector") == size)
    width = size // parts
    books = np.floor(scale * np.array(first, np.float64)).astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    fields = [StructField("vec_id", LongType()), *(StructField(f"carried_{i}", vectors.schema[c].dataType) for i, c in enumerate(carry))]
    schema = StructType([*(StructField(f.name, ArrayType(f.dataType)) for f in fields), StructField("largest", LongType()), *(StructField(f"{name}_{p}", BinaryType()) for p in range(parts) for name in ("points", "order", "low", "high", "total"))])
    names = [f.name for f in fields]

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(table: pa.Table) -> pa.RecordBatch:
            whole = table.combine_chunks()
            flat = whole.column("vector").combine_chunks().flatten().to_numpy()
            points = np.floor(scale * flat).astype(np.int64).reshape(-1, parts, width)
            kept = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c).combine_chunks()) for c in names]
            trees = [pa.array([raw], pa.binary()) for p in range(parts) for raw in Tree.of(np.ascontiguousarray(points[:, p])).packed()]
            return pa.RecordBatch.from_arrays([*kept, pa.array([int(np.abs(points).max())]), *trees], schema.names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, CHUNK_ROWS - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == CHUNK_ROWS:
                    yield chunk(pa.Table.from_batches(held))
                    held = []
        if held:
            yield chunk(pa.Table.from_batches(held))

    trees = written(rows.mapInArrow(of_batches(planted), schema), "trees")
    largest = trees.agg(F.max("largest")).first()[0] or 0
    largest = max(largest, int(np.abs(books).max()) if books.size else 0)
    kind = np.float64 if 4 * width * largest**2 < 2**53 else np.int64

    def filtered(batch: pa.RecordBatch, r: int, books: np.ndarray) -> Iterator[tuple[int, Tree, Filtered]]:
        for p in range(parts):
            tree = Tree.unpacked([batch.column(f"{name}_{p}")[r].as_py() for name in ("points", "order", "low", "high", "total")], width)
            yield p, tree, Filtered(tree, books[p], kind)

    for _ in range(rounds if books.size else 0):

        def summed(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((*books.shape[:2], width + 1), np.int64)  # the count is last
            for batch in batches:
                for r in range(batch.num_rows):
                    for p, _, found in filtered(batch, r, books):
                        sums[p, :, :-1] += found.sums
                        sums[p, :, -1] += found.counts
            flat = sums.reshape(-1)
            used = np.flatnonzero(np.repeat(sums[:, :, -1].reshape(-1) > 0, width + 1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(flat[used])], ["place", "n"])

        totals = trees.mapInArrow(of_batches(summed), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros(books.shape[0] * books.shape[1] * (width + 1), np.int64)
        sums[[r["place"] for r in totals]] = [r["n"] for r in totals]
        sums = sums.reshape(*books.shape[:2], width + 1)
        count = sums[:, :, -1:]
        books = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                index, error = [], 0
                for p, tree, found in filtered(batch, r, books):
                    place = np.empty(len(tree.order), np.int64)
                    place[tree.order] = np.arange(len(tree.order))
                    entry = found.entry[place]
                    apart = tree.points[place].astype(np.int64) - books[p][entry]
                    index.append(entry)
                    error = error + (apart * apart).sum(1)
                hex_ = np.stack(index, 1).astype(np.uint8).tobytes().hex()
                code = [hex_[i : i + 2 * parts] for i in range(0, len(hex_), 2 * parts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[r].values for c in names), pa.array(code, pa.string()), pa.array(error)], [*names, "code", "error"])

    out = trees.mapInArrow(of_batches(coded), StructType([*fields, StructField("code", StringType()), StructField("error", LongType())]))
    return Codes(out.select("vec_id", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)), "code", "error"), books)
