"""Candidate windows of texts: sentences, a gate, windows that are merged, and chunks of bounded length.

A text's sentences stay together in arrays of its row, so that nothing is shuffled and chunks follow by a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences on either side of a candidate, and the most characters of a chunk.
AROUND, MOST_CHARS = 2, 1500


def sentences(text: str) -> Column:
    """The sentences of a text with what separates them: a sentence ends after . ! or ? and white space, or before two
    line ends; parts join to the text again."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"((?<=[.!?])\s+|\n{2,})", "$1\u0001"), "\u0001"), lambda s: F.length(s) > 0)


def windows(flags: Column, around: int = AROUND) -> Column:
    """Runs [first, last] of places near a true flag: around of each side, joined where they meet or touch."""
    n = F.size(flags)
    hits = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def add(out: Column, i: Column) -> Column:
        first, last = F.greatest(i - around, F.lit(0)), F.least(i + around, n - 1)
        held = F.try_element_at(out, F.lit(-1))
        wider = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(held["first"].alias("first"), last.alias("last"))))
        return F.when((F.size(out) > 0) & (first <= held["last"] + 1), wider).otherwise(F.concat(out, F.array(F.struct(first.alias("first"), last.alias("last")))))

    return F.aggregate(hits, empty, add)


def packed(parts: Column, most: int = MOST_CHARS) -> Column:
    """Texts of parts in order, each filled with whole parts up to most characters; a longer part stands alone."""

    def add(out: Column, part: Column) -> Column:
        held = F.try_element_at(out, F.lit(-1))
        fits = (F.size(out) > 0) & (F.length(held) + F.length(part) <= most)
        return F.when(fits, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(held, part)))).otherwise(F.concat(out, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def candidate_chunks(docs: DataFrame, doc_id: str, text: str, gate: str, around: int = AROUND, most: int = MOST_CHARS) -> DataFrame:
    """doc_id, window, part and text: chunks of the windows around sentences that match the pattern gate. Texts without
    a match, null and empty ones have none."""
    split = docs.select(doc_id, sentences(text).alias("s")).where(F.size("s") > 0)
    spans = split.select(doc_id, "s", F.posexplode(windows(F.transform("s", lambda x: x.rlike(gate)), around)).alias("window", "w"))
    parts = packed(F.slice("s", F.col("w.first") + 1, F.col("w.last") - F.col("w.first") + 1), most)
    return spans.select(doc_id, "window", F.posexplode(parts).alias("part", "text"))
