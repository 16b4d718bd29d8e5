"""Token counts: heap-and-linked-list byte-pair merging that counts and emits no ids."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import REMEMBERED, PieceValues
from .storage import of_batches, worker_held

#: Rows that are counted at once.
ROWS = 500


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens that byte-pair merging leaves of a text.

    vocabulary: path of a JSON file of the tokenizers library with byte-level BPE. Its special strings, where they
    stand in a text, count as one token each, as in that library.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            held = json.load(f)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"])
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.words = regex.compile(pattern).findall
        special = [t["content"] for t in held.get("added_tokens", []) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}
        self.pieces = PieceValues(lambda new: [*map(self.count, new)])

    def merge_count(self, word: str) -> int:
        """Symbols of a word less its merges: the pair of least rank, leftmost first, is popped and joined."""
        symbols = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        n = left = len(symbols)
        after, before, rank = [*range(1, n), -1], [*range(-1, n - 1)], self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j < 0 or rank((symbols[i], symbols[j])) != r:
                continue  # a part of the pair has been joined to another since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            for word in self.words(part):
                if (n := self.known.get(word)) is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    n = self.known[word] = self.merge_count(word)
                total += n
        return total

    def counts(self, texts: list[str]) -> list[int]:
        return [*map(sum, self.pieces.of(texts))]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row's whole text.

    Null and empty texts have 0 bytes and tokens. Repeated rows and null ids give a row each. Other columns aren't read.
    Work: one pass over the texts, without a shuffle; a worker remembers a bounded number of pieces.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_held(("counts", vocabulary, pattern), lambda: MergeCounter(vocabulary, pattern))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = counter.counts([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = read.mapInArrow(of_batches(counted), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
