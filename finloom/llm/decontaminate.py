"""Benchmark decontamination: one Aho-Corasick automaton of all windows of benchmark items, run once over each text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import of_batches, row_column, with_row, worker_held, written

#: A-Z become a-z, other ASCII characters than letters and digits become blanks; bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in a text whose A-Z are as they were

#: Bytes of benchmark text that one automaton may hold; it takes about 60 times as much memory in each worker.
MOST_BYTES = 4_000_000

HITS = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(words: list[bytes], size: int) -> set[bytes]:
    """Each run of size words, blanks between and around; all words if they are fewer; none if there are none."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))}


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


class Scanner:
    """items: (item_id, text) pairs. Two items may share a window."""

    def __init__(self, items: tuple[tuple[str, str | None], ...], size: int):
        import ahocorasick

        self.automaton, owners = ahocorasick.Automaton(), {}
        for item_id, text in items:
            for w in windows(normal_words(text), size):
                owners.setdefault(w, set()).add(item_id)
        for w, ids in owners.items():
            self.automaton.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(ids)))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def found(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are in an occurring window, and the items with such windows, sorted."""
        hit = np.zeros(len(words) + 1, np.int64)
        if not words or not self.any:
            return hit[:-1] > 0, []
        joined = b" " + b" ".join(words) + b" "
        found = [(end, *what) for end, what in self.automaton.iter(joined.decode("latin-1"))]
        if not found:
            return hit[:-1] > 0, []
        begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])  # of the blank before each word
        for end, length, n, _ in found:
            first = int(np.searchsorted(begins, end - length + 1))
            hit[first] += 1
            hit[first + n] -= 1
        return np.cumsum(hit[:-1]) > 0, sorted({i for *_, ids in found for i in ids})

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        """Words, hit words, items with occurring windows, and the hit words' spans in the text, in characters."""
        words = normal_words(text)
        marked, ids = self.found(words)
        return len(words), int(marked.sum()), ids, self._spans(text, marked) if ids else []

    @staticmethod
    def _spans(text: str, marked: np.ndarray) -> list[tuple[int, int]]:
        """Runs of marked words as character offsets [start, end) of the original."""
        raw = text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in _WORD.finditer(raw)]
        at = [(places[a][0], places[b - 1][1]) for a, b in _runs(marked)]
        character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to and with each byte
        return [(int(character[a]) - 1, int(character[b - 1])) for a, b in at]


def _pieces(text: str | None, size: int, most_bytes: int) -> Iterator[str]:
    """The text, or over most_bytes pieces of it that hold each of its windows (one at least, whatever its size)."""
    if len(text or "") <= most_bytes and len((text or "").encode("utf-8", "surrogatepass")) <= most_bytes:
        yield text or ""
        return
    words = normal_words(text)
    begin = 0
    while begin < len(words):
        end, held = min(len(words), begin + size), sum(len(w) + 1 for w in words[begin : begin + size])
        while end < len(words) and held + len(words[end]) + 1 <= most_bytes:
            held += len(words[end]) + 1
            end += 1
        yield b" ".join(words[begin:end]).decode("utf-8", "surrogatepass")
        if end == len(words):
            return
        begin = end - size + 1


def _parts(items: Iterator, size: int, most_bytes: int) -> Iterator[tuple[tuple[str, str], ...]]:
    """The items in parts of about most_bytes of text at most."""
    part: list[tuple[str, str]] = []
    held = 0
    for item_id, text in items:
        for piece in _pieces(text, size, most_bytes):
            n = len(piece.encode("utf-8", "surrogatepass"))
            if part and held + n > most_bytes:
                yield tuple(part)
                part, held = [], 0
            part.append((item_id, piece))
            held += n
    if part:
        yield tuple(part)


def _hits_by_part(docs: DataFrame, items: DataFrame, window: int, most_bytes: int, carry: bool) -> DataFrame:
    """benchmark_hits with one pass over the texts for each part of the items; what they find is merged by text."""
    spark = docs.sparkSession
    texts = docs.where(F.col("text").isNotNull()).select(F.md5(F.col("text").cast("binary")).alias("h"), "text")
    hits = []
    for items_of_part in _parts(items.toLocalIterator(), window, most_bytes):
        held = spark.sparkContext.broadcast(items_of_part)

        def marked(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            scanner = worker_held(("windows", held.value, window), lambda: Scanner(held.value, window))
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            for batch in batches:
                rows = [(h, *scanner.found(normal_words(t))) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                rows = [(h, ids, [{"a": a, "b": b} for a, b in _runs(at)]) for h, at, ids in rows if ids]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["h", "ids", "runs"])

        found = texts.mapInArrow(of_batches(marked), "h string, ids array<string>, runs array<struct<a:long,b:long>>")
        hits.append(written(found.dropDuplicates(["h"]), "benchmark-part"))
        held.unpersist()
    every = reduce(DataFrame.union, hits)
    merged = every.groupBy("h").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"), F.flatten(F.collect_list("runs")).alias("runs"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            rows = []
            texts = batch.column(3).field("text") if carry else batch.column(3)
            for text, ids, runs in zip(texts.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = np.zeros(len(normal_words(text)), bool)
                for r in runs or []:
                    at[r["a"] : r["b"]] = True
                rows.append((len(at), int(at.sum()), sorted(ids or []), [{"start": a, "end": b} for a, b in Scanner._spans(text, at)] if ids else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), *batch.columns[3 : 3 + carry]], ["doc_id", "n_words", "n_hit", "item_ids", "spans", "row"][: 5 + carry])

    read = docs.select(F.md5(F.col("text").cast("binary")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), *(row_column(carry) or ["text"]))
    joined = read.join(merged, "h", "left").select("doc_id", "ids", "runs", "row" if carry else "text")
    return joined.mapInArrow(of_batches(counted), with_row(HITS, docs, carry))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = MOST_BYTES, carry: bool = False) -> DataFrame:
    """Of every whole text: doc_id, n_words, n_hit (words in any occurrence of a window), item_ids (with an occurring
    window, sorted as strings) and spans (of the hit words in the original, in characters); with carry also row, all
    columns of docs in one.

    Null and empty texts have no words; items without words never occur; a null item_id counts as ''; repeated items
    and rows are all used. An empty benchmark hits nothing. Other columns aren't read. The benchmark goes to every
    worker, so its size is measured first: over most_bytes of text it goes there in parts of that size, one by one.
    Work: one pass over the texts, without a shuffle; with parts one for each, and a join by text with what they found.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > most_bytes:
        return _hits_by_part(docs, items, window, most_bytes, carry)
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(((r["i"], r["text"]) for r in items.collect()), key=str)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_held(("windows", held.value, window), lambda: Scanner(held.value, window))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(d, n, k, ids, [{"start": a, "end": b} for a, b in spans]) for d, (n, k, ids, spans) in zip(part.column(0).to_pylist(), map(scanner.scan, (part.column(1).field("text") if carry else part.column(1)).to_pylist()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), *part.columns[1 : 1 + carry]], ["doc_id", "n_words", "n_hit", "item_ids", "spans", "row"][: 5 + carry])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(row_column(carry) or ["text"])).mapInArrow(of_batches(scanned), with_row(HITS, docs, carry))
