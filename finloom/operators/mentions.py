"""Names of a large list in texts, and chunks of text round sentences that may speak of relations.

Names are found as one alternation of all of them would, longest first: at the leftmost place the longest name, then on
after its end. Only the names move, so many at once as fit a task: each text is passed over where it lies, its letters
looked up among the beginnings of names, and what is found stays beside it in its row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from .notes import cut_at

#: What parts sentences; words of relations; sentences on either side of a candidate; characters of a chunk.
SENTENCE_END = r"(?<=[.!?])\s+|\n{2,}"
RELATION_WORDS = (
    "매출처", "공급처", "공급받", "공급하", "공급계약", "납품", "매입처", "매입",
    "원재료", "원자재", "구매처", "판매처", "거래처", "고객사", "주요 고객", "수주",
    "발주", "협력사", "벤더", "조달", "경쟁사", "경쟁업체", "경쟁회사", "OEM", "ODM",
)
AROUND, MOST_CHARS, SHORTEST = 2, 1500, 2
#: Names that are sent to the tasks at once; rows, and letters of texts, that are passed over before what they hold is handed on.
NAMES_AT_ONCE, ROWS, LETTERS = 100_000, 500, 1 << 20


def sentence_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, i (from 0), start, end (characters) and sentence of each sentence of a text but blank ones."""
    by = Window.partitionBy(key).orderBy("nth")
    rows = cut_at(docs, key, text, SENTENCE_END).withColumn("_h", F.coalesce(F.length("head"), F.lit(0)))
    end = F.sum(F.length("part") + F.col("_h")).over(by)
    rows = rows.withColumn("end", end.cast("int")).where(F.col("part").rlike(r"\S"))
    return rows.select(key, (F.row_number().over(by) - 1).alias("i"), (F.col("end") - F.length("part")).alias("start"), "end", F.col("part").alias("sentence"))


class _Names:
    """The longest of some names at a place of a text, found by the two letters there and the lengths of names that begin so."""

    def __init__(self, names: list[str]):
        self.held, sizes = {*names}, {}
        for n in self.held:
            sizes.setdefault(n[:SHORTEST], set()).add(len(n))
        self.sizes = {b: sorted(s, reverse=True) for b, s in sizes.items()}

    def longest(self, text: str, at: int) -> int:
        for n in self.sizes.get(text[at : at + SHORTEST], ()):
            if text[at : at + n] in self.held and at + n <= len(text):
                return n
        return 0

    def every(self, text: str, before: bytes | None) -> bytes:
        """The longest at each place, 4 bytes each; before: what other names have there."""
        own = np.fromiter((self.longest(text, i) for i in range(len(text))), "<i4", len(text))
        return (own if before is None else np.maximum(own, np.frombuffer(before, "<i4"))).tobytes()

    def leftmost(self, text: str, before: bytes | None) -> Iterator[dict]:
        """at and name from left to right, none beginning inside another."""
        others, at, last = None if before is None else np.frombuffer(before, "<i4").tolist(), 0, len(text) - SHORTEST
        sizes, held = self.sizes.get, self.held
        while at <= last:
            size = others[at] if others else 0
            for n in sizes(text[at : at + SHORTEST], ()):
                if n <= size:
                    break
                if text[at : at + n] in held and at + n <= len(text):
                    size = n
                    break
            if size:
                yield {"at": at, "name": text[at : at + size]}
            at += size or 1


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """batch in parts of ROWS rows and LETTERS letters at most, but for longer texts, which are alone."""
    first, size = 0, 0
    for i, t in enumerate(batch.column(text)):
        n = len(t.as_py() or "")
        if i > first and (i - first >= ROWS or size + n > LETTERS):
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if batch.num_rows > first:
        yield batch.slice(first)


def with_names(rows: DataFrame, text: str, names: DataFrame, name: str, found: str = "found") -> DataFrame:
    """rows with found: at (characters before it) and name of each name in a text, from left to right, none overlapping
    another: the leftmost, of several there the longest. Letters count as they are; names are trimmed, null ones and those
    shorter than SHORTEST don't count. Null texts have none.

    Work: one pass over each text where it lies, for each NAMES_AT_ONCE names; nothing but names moves. All but the last pass
    leave the length of the longest name at each place beside the text, 4 bytes a letter.
    """
    spark = rows.sparkSession
    listed = names.select(F.regexp_replace(name, r"^\s+|\s+$", "").alias("name")).where(F.length("name") >= SHORTEST).distinct()
    parts = -(-listed.count() // NAMES_AT_ONCE) or 1
    sizes = "_sizes_" + found

    def passed(rows: DataFrame, part: int) -> DataFrame:
        own = listed.where(F.pmod(F.hash("name"), F.lit(parts)) == part)
        sent, last, before = spark.sparkContext.broadcast([r["name"] for r in own.collect()]), part == parts - 1, part > 0
        kept = StructType([f for f in rows.schema if f.name != sizes])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("name", pa.string())])) if last else pa.binary()

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = None
            for batch in batches:
                book = book or _Names(sent.value)
                for some in _slices(batch, text):
                    texts = some.column(text).to_pylist()
                    held = some.column(sizes).to_pylist() if before else [None] * len(texts)
                    find = (lambda t, b: [*book.leftmost(t, b)]) if last else book.every
                    values = pa.array([[] if last and t is None else None if t is None else find(t, b) for t, b in zip(texts, held, strict=True)], kind)
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept.names), values], [*kept.names, found if last else sizes])

        return rows.mapInArrow(of, StructType([*kept]).add(found if last else sizes, ArrayType(StructType.fromDDL("at int, name string")) if last else BinaryType()))

    for part in range(parts):
        rows = passed(rows, part)
    return rows


def names_in_texts(texts: DataFrame, keys: Sequence[str], text: str, names: DataFrame, name: str) -> DataFrame:
    """keys, at and name of each name found in a text, by with_names()."""
    found = with_names(texts.select(*keys, F.col(text).alias("_text")), "_text", names, name, "_found")
    return found.select(*keys, F.inline("_found"))


def candidates(docs: DataFrame, key: str, text: str, names: DataFrame, name: str, own: DataFrame, words: Sequence[str] = RELATION_WORDS) -> DataFrame:
    """sentence_rows of docs with candidate: whether a sentence has one of words, or a name that isn't one of its document's
    own (key, name)."""
    rows = sentence_rows(docs, key, text)
    pattern = "|".join("\\Q" + w + "\\E" for w in words)
    rows = rows.withColumn("_word", F.col("sentence").rlike(pattern) if words else F.lit(False))
    # sentences with a word aren't searched, and what is found is compared in its row
    met = with_names(rows.withColumn("_asked", F.when(~F.col("_word"), F.col("sentence"))), "_asked", names, name, "_met")
    theirs = own.select(key, F.regexp_replace(name, r"^\s+|\s+$", "").alias("name")).groupBy(key).agg(F.collect_set("name").alias("_own"))
    others = F.exists("_met", lambda m: ~F.coalesce(F.array_contains("_own", m["name"]), F.lit(False)))
    return met.join(theirs, key, "left").withColumn("candidate", F.col("_word") | others).drop("_word", "_asked", "_met", "_own")


def chunks_of(docs: DataFrame, key: str, text: str, rows: DataFrame, around: int = AROUND, most: int = MOST_CHARS) -> DataFrame:
    """key, seq (from 0), start, end and text of chunks: runs of sentences (rows of sentence_rows with candidate) within
    around of a candidate, in parts of whole sentences with most characters of them at most. A longer sentence is cut to
    that. The same rows give the same chunks."""
    by = Window.partitionBy(key).orderBy("i")
    near = F.max(F.col("candidate")).over(by.rowsBetween(-around, around))
    held = rows.select(key, "i", "start", "end", near.alias("_near")).where("_near")
    held = held.withColumn("_run", F.col("i") - F.row_number().over(by))
    runs = held.groupBy(key, "_run").agg(F.sort_array(F.collect_list(F.struct("i", "start", "end"))).alias("s"))
    begin = F.struct(F.lit(None).cast("int").alias("total"), F.array().cast("array<int>").alias("starts"))

    def add(state: Column, x: Column) -> Column:
        size = x["end"] - x["start"]
        fits = state["total"] + size <= most
        return F.when(fits, F.struct((state["total"] + size).alias("total"), state["starts"].alias("starts"))).otherwise(F.struct(size.alias("total"), F.concat(state["starts"], F.array(x["i"])).alias("starts")))

    cut = runs.withColumn("p", F.aggregate("s", begin, add, lambda a: a["starts"])).withColumn("f", F.get("s", F.lit(0))["i"])
    last = lambda k: F.coalesce(F.get("p", k + 1) - F.col("f") - 1, F.size("s") - 1)
    spans = cut.select(key, F.inline(F.transform("p", lambda i, k: F.struct(F.get("s", i - F.col("f"))["start"].alias("start"), F.get("s", last(k))["end"].alias("end")))))
    spans = spans.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1).withColumn("end", F.least("end", F.col("start") + most))
    return docs.select(key, F.col(text).alias("_text")).join(spans, key).select(key, "seq", "start", "end", F.expr("substr(_text, start + 1, end - start)").alias("text"))
