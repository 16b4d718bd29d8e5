"""Mixing sources to target weights, by blocks of words.

The words of each source, its rows in the order of a hash, are packed into blocks of one length. Output shards draw how
many blocks of each source they take, multinomially by what the sources have left of their targets: in halves, from all
shards down to one, each draw seeded by the shards it parts, so that any task finds the counts of its own shards. A
source's slots, over all shards, are mapped to its blocks through pseudorandom permutations, one for each time round,
and joined to the blocks by number. No source goes round more than cap times, so no document is taken more often.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .storage import of_batches, partitions, written
from .words import mix, word_blocks

WORD = r"[^\x20\x09-\x0D]+"

#: Parts of each source's hash order in which words are summed before positions are known; 2 to the power.
RANGE_BITS = 12
#: Shards whose slots are drawn in one go.
RUN = 8
#: Most sources: a row for each comes to the driver and goes to every task.
MOST_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Words to take of each source: share of all by weight, none above cap times its size, the excess reshared."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in full or open_:
            out[i] = cap * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def shard_counts(slots: Sequence[int], shard_slots: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, count of each source, its first slot) of the shards from low to high. All shards' counts of a source add up
    to its slots, and a shard's of all sources to shard_slots (the last's to what is left)."""
    whole = np.array(slots, np.int64)
    shards = -(-int(whole.sum()) // shard_slots)
    todo = [(0, shards, whole, np.zeros_like(whole))] if shards else []
    while todo:
        a, b, held, first = todo.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, held, first
            continue
        middle = (a + b) // 2
        rng, taken, open_ = np.random.default_rng([seed, a, b]), np.zeros_like(held), (middle - a) * shard_slots
        while open_:  # what a source hasn't left is drawn again
            rest = held - taken
            more = np.minimum(rng.multinomial(open_, rest / rest.sum()), rest)
            taken += more
            open_ -= int(more.sum())
        todo += [(middle, b, held - taken, first + taken), (a, middle, taken, first)]


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of the numbers below size, by key: a Feistel network, walked until it is below size."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        high, low = x >> np.uint64(half), x & mask
        for turn in range(4):
            with np.errstate(over="ignore"):
                high, low = low, high ^ (mix(low + np.uint64((key * 4 + turn) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & mask)
        out[todo] = high << np.uint64(half) | low
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


class Mix:
    """sources: source, number, source_size, target and blocks of each source. rows: of each document its doc_id, number, size
    and key (part, nth); taken: of each piece taken its key, shard, slot, block, round, from_word and n_words."""

    def __init__(self, sources: DataFrame, rows: DataFrame, taken: DataFrame, seed: int):
        self.sources, self.rows, self.taken, self.seed = sources, rows, taken, seed


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, block_words: int = 128, shard_blocks: int = 4096, seed: int = 17) -> Mix:
    """The mix of docs (doc_id, source, text). Sources by code point, null last, weigh weights, repeating.

    Null and blank texts have no words and are never taken; a null source is one of its own; repeated rows are packed
    each. Without words nothing is taken. Other columns aren't read. More than MOST_SOURCES sources raise ValueError.
    Reruns agree: the order is by a hash of id and text, draws and permutations by seed. A very long text is as many
    pieces as it has blocks, wherever it is cut.
    Work: words are counted where texts are read; what is shuffled has no text. A source's words are summed by ranges
    of its hash order, so that no task gets a source; slots are drawn and permuted by tasks for a few shards each. The
    driver holds a row for each source.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    slim = written(slim.withColumn("part", F.shiftright("h", 64 - RANGE_BITS).cast("int")), "sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums = sorted(((r["source"], r["size"]) for r in sums), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    goal = targets([n for _, n in sums], [weights[i % len(weights)] for i in range(len(sums))], share, cap)
    blocks = [-(-n // block_words) for _, n in sums]
    # the last block of a source may be short, so a slot brings the mean
    slots = [min(round(t * b / n), cap * b) if n else 0 for t, b, (_, n) in zip(goal, blocks, sums, strict=True)]
    kinds = pa.schema([("source", pa.string()), ("number", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64()), ("blocks", pa.int64())])
    columns = [[s for s, _ in sums], range(len(sums)), [n for _, n in sums], goal, blocks]
    # as an Arrow table it reaches the JVM without Python workers of another kind, which would stay beside those in use
    sources = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds))
    numbered = slim.join(F.broadcast(sources.select(F.col("source").alias("s"), "number")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    own = Window.partitionBy("number", "part").orderBy("h", "doc_id")
    placed = numbered.withColumn("nth", F.row_number().over(own)).withColumn("before", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    ranges = numbered.groupBy("number", "part").agg(F.sum("size").alias("n"))
    starts = ranges.select("number", "part", (F.sum("n").over(Window.partitionBy("number").orderBy("part")) - F.col("n")).alias("range_start"))
    rows = placed.join(starts, ["number", "part"]).withColumn("start", F.col("range_start") + F.col("before")).drop("before", "range_start")
    end = F.col("start") + F.col("size")
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = cut.select("number", "part", "nth", "doc_id", "h", "block", (low - F.col("start")).alias("from_word"), (F.least(end, (F.col("block") + 1) * block_words) - low).alias("n_words"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in batch.column(0).to_pylist():
                for shard, counts, first in shard_counts(slots, shard_blocks, seed, low, low + RUN):
                    for s in np.flatnonzero(counts).tolist():
                        j = np.arange(first[s], first[s] + counts[s])
                        turn = j // blocks[s]
                        block = np.concatenate([permuted(j[turn == t] % blocks[s], blocks[s], seed + 1000 * s + t) for t in np.unique(turn).tolist()])
                        kept = [np.full(len(j), shard, np.int64), np.full(len(j), s, np.int32), j, block, turn.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], ["shard", "number", "j", "block", "round"])

    shards = -(-sum(slots) // shard_blocks)
    runs = spark.range(0, shards, RUN, max(1, min(-(-shards // RUN), 4 * partitions(spark))))
    chosen = runs.mapInArrow(of_batches(mapped), "shard long, number int, j long, block long, round int")
    # the slots grow with the corpus, which Spark can't tell from the few rows that they are spread from
    taken = pieces.join(chosen.hint("merge"), ["number", "block"]).withColumn("slot", F.xxhash64(F.lit(seed), "shard", "number", "j"))
    return Mix(sources, rows, taken, seed)


def taken_words(mix_: Mix) -> DataFrame:
    """Of every row of the documents: doc_id, size, source_size, target (of its source) and taken, repeats counted."""
    key = ["number", "part", "nth"]
    parts = mix_.rows.select(*key, "doc_id", "size", F.lit(0).cast("long").alias("n")).unionByName(mix_.taken.select(*key, F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"), F.col("n_words").alias("n")))
    totals = parts.groupBy(*key).agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sum("n").alias("taken"))
    return totals.join(F.broadcast(mix_.sources.select("number", "source_size", "target")), "number").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, mix_: Mix) -> DataFrame:
    """docs as mixed: of each document a row for each round that takes words of it, with those words in their order as
    text (white space stays with the word before it) and n_chars theirs; the other columns as they are.

    Rows of one id and text are told apart by their source, those of one source by their other columns (as JSON); rows
    alike in all columns are any of each other.
    Work: one shuffle of the texts, to meet the word ranges taken of them.
    """
    spans = mix_.taken.groupBy("doc_id", "number", "h", "nth", "round").agg(F.sort_array(F.collect_list(F.struct(F.col("from_word").cast("int").alias("at"), F.col("n_words").cast("int").alias("n")))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("id"), F.col("number").alias("m"), F.col("h").alias("g"), "spans", F.dense_rank().over(Window.partitionBy("doc_id", "number", "h").orderBy("nth")).alias("nth"))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("s"), F.xxhash64(F.lit(mix_.seed), "doc_id", "text").alias("h"))
    numbers = F.broadcast(mix_.sources.select(F.col("source").alias("named"), "number"))
    marked = marked.join(numbers, F.col("s").eqNullSafe(F.col("named"))).drop("s", "named")
    marked = marked.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "number", "h").orderBy(F.to_json(F.col("row").dropFields("text") if len(docs.columns) > 1 else F.col("row")))))
    met = marked.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("number") == F.col("m")) & (F.col("h") == F.col("g")) & (F.col("copy") == F.col("nth")))
    schema = StructType([StructField(f.name, {"text": StringType(), "n_chars": LongType()}.get(f.name, f.dataType), True) for f in docs.schema.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, names = batch.column(0), schema.names
            mixed = pa.array(_cut(row.field(names.index("text")), batch.column(1).to_pylist()), pa.string())
            new = {"text": mixed, "n_chars": pa.compute.utf8_length(mixed).cast(pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, row.field(i)) for i, n in enumerate(names)], names)

    return met.select("row", "spans").mapInArrow(of_batches(cut), schema)


def _cut(texts: pa.Array, spans: list[list[dict[str, int]]]) -> Iterator[str]:
    """Of each text its spans of n words from word at on, one after the other, each word with the white space after it."""
    for first, last, words in word_blocks(texts):
        raw, starts = words.raw.tobytes(), [*words.start.tolist(), 0]
        for i in range(first, last):
            low, high = words.first[i - first : i - first + 2].tolist()
            end = int(words.ends[i - first])
            cuts = ((low + s["at"], low + s["at"] + s["n"]) for s in spans[i])
            yield b"".join(raw[starts[a] : starts[b] if b < high else end] for a, b in cuts).decode("utf-8", "replace")
