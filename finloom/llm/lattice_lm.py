"""LM scoring: the probability of a text over all ways to cut its words into pieces of a subword vocabulary.

A word's lattice has an edge for each piece of the vocabulary at each place, and one for each byte, so that any word has
a path. One table scores the edges: relative frequencies of the pieces in the training texts, of those that begin a word
and of others apart, with the chance that a word goes on. The forward recursion adds, in logarithms, the edges that end
at each place; its last value is the word's marginal probability. A text is a run of words and one end: each word has
the chance of a token other than the end, times its marginal; so all texts together have a probability of 1 at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import ROWS, SUMMARY, answered, chunked, found, layout, received, send
from .storage import of_batches, of_group, of_groups, worker_held, written
from .words import _LOWER, word_blocks

#: Added to the count of each byte, so that each word has a path.
BYTE_COUNT = 0.5
#: Distinct words that a task counts before it cuts them into pieces.
WORDS = 200_000
#: Words up to so many bytes are scored together, longer ones one by one.
SHORT_WORD = 40

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_MARK = "▁"


def piece_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """piece and n: how often the words of texts, cut by the vocabulary's own rule, hold each of its pieces."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        cutter, words = worker_held(("pieces", vocabulary), lambda: sentencepiece.SentencePieceProcessor(model_file=vocabulary)), Counter()
        total = np.zeros(cutter.get_piece_size(), np.int64)

        def cut() -> None:
            ordered = [*words]
            pieces = cutter.encode([w.decode("utf-8", "replace") for w in ordered], num_threads=1)
            sizes = [len(p) for p in pieces]
            ids = np.fromiter((i for p in pieces for i in p), np.int64, sum(sizes))
            total[:] += np.bincount(ids, np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes), len(total)).astype(np.int64)
            words.clear()

        table = _LOWER.tobytes()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update((text or "").encode("utf-8", "surrogatepass").translate(table).split())
                if len(words) > WORDS:
                    cut()
        if words:
            cut()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([cutter.id_to_piece(int(i)) for i in held], pa.string()), pa.array(total[held])], ["piece", "n"])

    return texts.select("text").mapInArrow(of_batches(counted), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """counts: of pieces, those that begin a word with the mark; byte pieces as <0xNN>; others in < > are left out."""

    def __init__(self, counts: dict[str, int]):
        first: dict[bytes, float] = {}
        later: dict[bytes, float] = {bytes([b]): BYTE_COUNT for b in range(256)}
        words = 0
        for piece, n in counts.items():
            if piece.startswith("<0x") and len(piece) == 6:
                later[bytes([int(piece[3:5], 16)])] += n
            elif piece.startswith(_MARK):
                first[piece[1:].encode()] = first.get(piece[1:].encode(), 0) + n
                words += n
            elif not (piece.startswith("<") and piece.endswith(">")):
                later[piece.encode()] = later.get(piece.encode(), 0) + n
        first[b""] = first.get(b"", 0) + BYTE_COUNT
        ends = (words + 1) / (words + sum(later.values()) + 1)  # the chance that a word ends with a piece
        self.end = log(ends)
        more = log(1 - ends)
        a, b = sum(first.values()), sum(later.values())
        self.first = {k: log(n / a) for k, n in first.items()}
        self.later = {k: log(n / b) + more for k, n in later.items()}
        self.longest = max(map(len, [*self.first, *self.later]))
        self.tables = [self._trie(self.first), self._trie(self.later)]

    @staticmethod
    def _trie(scores: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
        nodes: dict[bytes, int] = {b"": 0}
        for piece in scores:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        follow = np.zeros((len(nodes), 256), np.int32)  # 0: none, as no piece leads back to the start
        value = np.full(len(nodes), -np.inf)
        for prefix, i in nodes.items():
            if prefix:
                follow[nodes[prefix[:-1]], prefix[-1]] = i
            value[i] = scores.get(prefix, -np.inf)
        return follow, value

    def word(self, word: bytes) -> float:
        """The log probability of a word, one place after the other."""
        total = [float("-inf")] * (len(word) + 1)
        total[0] = self.first[b""]
        for k in range(1, min(self.longest, len(word)) + 1):
            if (s := self.first.get(word[:k])) is not None:
                total[k] = s
        for i in range(len(word)):
            for k in range(i + 1, min(i + self.longest, len(word)) + 1):
                if (s := self.later.get(word[i:k])) is not None:
                    total[k] = float(np.logaddexp(total[k], total[i] + s))
        return total[-1] + self.end

    def words(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word."""
        out = np.empty(len(words))
        sizes = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(sizes > SHORT_WORD):
            out[i] = self.word(words[i])
        short = np.flatnonzero(sizes <= SHORT_WORD)
        short = short[np.argsort(-sizes[short], kind="stable")]
        if not len(short):
            return out
        length = sizes[short]
        raw = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        begin = np.cumsum(length) - length
        width = int(length[0])
        active = np.searchsorted(-length, -np.arange(1, width + 1), "right")
        letters = np.zeros((width, len(short)), np.uint8)
        for t, n in enumerate(active):
            letters[t, :n] = raw[begin[:n] + t]
        total = np.full((width + 1, len(short)), -np.inf)
        total[0] = self.first[b""]
        for i in range(-1, width):
            (follow, value), at = self.tables[i >= 0], max(i, 0)
            rows, node = np.arange(active[at] if width else 0), None
            node = np.zeros(len(rows), np.int32)
            for k in range(at, width):
                if len(rows) and rows[-1] >= active[k]:
                    rows = rows[: np.searchsorted(rows, active[k])]
                    node = node[: len(rows)]
                node = follow[node, letters[k, rows]]
                on = node > 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                s = value[node]
                ends = np.flatnonzero(s > -np.inf)
                r = rows[ends]
                total[k + 1, r] = np.logaddexp(total[k + 1, r], s[ends] + (total[at, r] if i >= 0 else 0))
        out[short] = total[length, np.arange(len(short))] + self.end
        return out


def score_texts(docs: DataFrame, vocabulary: str, held_out: Column) -> DataFrame:
    """Of every whole text (null: empty): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words, with A-Z as a-z, and one end; those of the rows not held out are learned from (a null
    held_out counts as false). n_known: tokens that are; train_tokens: all that are. base_score: log10 by add-one
    frequencies of tokens; score: log10 by the lattice. Without training rows only bytes score. Repeated rows count as
    often; a very long text or word is scored whole; other columns aren't read.
    vocabulary: path of a sentencepiece model, whose pieces come to the driver with their counts, as many as it has.
    Work: one pass to count pieces; the texts are dealt once to chunks, and word counts go packed between them.
    """
    spark, (chunks, parts) = docs.sparkSession, layout(docs)
    marked = docs.withColumn("_out", F.coalesce(held_out, F.lit(False)))
    pieces = {r["piece"]: r["n"] for r in piece_counts(marked.where("NOT _out"), vocabulary).collect()}
    dealt = chunked(marked, chunks, F.col("_out").alias("held_out")).groupBy("chunk")

    def own(table: pa.Table) -> pa.Table:
        """The chunk's distinct words, with how often its training rows have them; key 0 stands for the end."""
        learn = ~table.column("held_out").to_numpy()
        keys, counts = [np.zeros(1, np.uint64)], [np.array([learn.sum()], np.int64)]
        for a, b, words in word_blocks(table.column("text"), lower=True):
            row = np.repeat(np.arange(a, b), np.diff(words.first))
            distinct, at = np.unique(words.hash, return_inverse=True)
            keys.append(distinct)
            counts.append(np.bincount(at, learn[row], len(distinct)).astype(np.int64))
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        return send(table.column("chunk")[0].as_py(), distinct, np.bincount(at, np.concatenate(counts)).astype(np.uint32), parts, False)

    def totals(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(at)), np.bincount(at, counts).astype(np.int64)[at]

    def summary(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.bincount(at, counts).astype(np.int64)
        return np.array([total.sum(), (total > 0).sum()])

    answers = written(answered(dealt.applyInArrow(of_group(own), ROWS), np.dtype(np.uint32), False, totals, summary), "word-counts")
    sums = [np.frombuffer(r["extra"], np.int64) for r in answers.where(F.col("chunk") == SUMMARY).select("extra").collect()]
    n_all, n_types = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)
    held = spark.sparkContext.broadcast(tuple(sorted(pieces.items())))

    def scored(table: pa.Table, told: pa.Table) -> pa.Table:
        keys, totals = received(told, np.dtype(np.int64), False)
        lattice, floor = worker_held(("lattice", held.value), lambda: Lattice(dict(held.value))), n_all + n_types + 1
        out: list[np.ndarray] = []
        ends = int(totals[found(keys, np.zeros(1, np.uint64))[1][0]]) if len(keys) else 0
        end = (ends + 1) / (n_all + 2)
        for a, b, words in word_blocks(table.column("text"), lower=True):
            distinct, place, at = np.unique(words.hash, return_index=True, return_inverse=True)
            count = totals[found(keys, distinct)[1]]
            raw = words.raw.tobytes()
            spelled = lattice.words([raw[s:e] for s, e in zip(words.start[place].tolist(), words.end[place].tolist(), strict=True)])
            row = np.repeat(np.arange(b - a), np.diff(words.first))
            each = (np.ones(len(distinct)), count > 0, np.log10((count + 1) / floor), spelled / log(10) + log10(1 - end))
            out.append(np.stack([np.bincount(row, x[at], b - a).astype(float) for x in each], 1))
        total = np.concatenate(out) if out else np.zeros((0, 4))
        total += [1, ends > 0, log10((ends + 1) / floor), log10(end)]
        doc_id = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        flags = table.column("held_out").combine_chunks() if table.num_rows else pa.array([], pa.bool_())
        whole = lambda k: pa.array(total[:, k].astype(np.int64))
        return pa.table([doc_id, flags, whole(0), whole(1), pa.array(np.full(len(total), n_all)), pa.array(total[:, 2]), pa.array(total[:, 3])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.cogroup(answers.where(F.col("chunk") != SUMMARY).groupBy("chunk")).applyInArrow(of_groups(scored), SCORES)
