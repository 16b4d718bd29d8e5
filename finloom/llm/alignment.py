"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which ids that links.

A is a byte-level file of the tokenizers library, B a sentencepiece model with byte fallback; both see a blank and then
the text. Of the byte string, one packed bitset marks the ends of A's tokens and another those of B's. Their AND are the
shared cuts; popcounts before a cut (rank) tell how many tokens of each lie before it, so that two neighbouring cuts
(select) give a group's token ranges. Every A token of a group is linked with every B token of it.

Both cut before a blank or line end between two characters other than white space (pieces.py), so a piece between such
places is aligned once and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import ROWS, answered, found, layout, received, send
from .pieces import cut_pieces
from .storage import of_batches, of_group, of_groups, worker_held, written
from .token_counts import byte_letters
from .token_files import ByteLibrary

#: Pieces that a Python worker remembers, about 500 bytes each; longer ones than so many characters aren't.
REMEMBERED, LONGEST = 120_000, 200
#: Texts of a block: so many rows, or characters.
BLOCK_ROWS, BLOCK_CHARS = 1_000, 1 << 20
#: Links of a group that are expanded one by one; of more, those of distinct ids with their numbers.
EXPANDED = 1 << 12

#: A blank or line end and then no white space.
_PLAIN = re.compile(r"[ \n]\S+\Z").match

#: What stands for a blank in sentencepiece.
BLANK = "▁"

BLOCKS = "chunk int, keys binary, held binary, wide boolean, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sizes array<int>, at binary, times binary, digests array<string>, texts array<string>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

#: What a chunk tells of a pair: how many of its documents link it, and the A id, by which the parts find the highest.
TOLD = np.dtype([("n", "<u4"), ("a", "<u4")])


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of ids; all pairs of an A id share the high half, which is spread over all numbers."""
    with np.errstate(over="ignore"):
        return (a.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) << np.uint64(32) | b.astype(np.uint64)


class Bits:
    """A packed bitset over byte positions, with the number of bits before each of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[positions] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many bits are set up to each position, itself included."""
        word, bit = positions >> 6, (positions & 63).astype(np.uint64)
        low = np.uint64(2**64 - 1) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self) -> np.ndarray:
        """The positions of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligner:
    """Alignments of texts, piece by piece."""

    def __init__(self, byte_file: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor

        self.a = ByteLibrary(byte_file)
        tokenizer = self.a.tokenizer
        tokenizer.encode_special_tokens = True
        of = {letter: b for b, letter in enumerate(byte_letters())}
        held = tokenizer.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.a_bytes = {i: added[i].encode() if i in added else bytes(of[c] for c in t) for t, i in held.items()}
        self.b = SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)}
        self.a_size, self.b_size = (np.array([len(of.get(i, b"")) for i in range(max(of, default=0) + 1)], np.int64) for of in (self.a_bytes, self.b_bytes))
        # each id in decimals with the mark after it: of A inside and at the end of its part of a group, of B the same
        self.a_said, self.b_said = ([np.array([f"{i}{mark}" for i in range(n)], object) for mark in marks] for n, marks in ((len(self.a_size), ",|"), (len(self.b_size), ",;")))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.numbers = np.zeros((0, 4), np.int64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys, self.times, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _ids(self, plain: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of pieces, each of which starts with a blank or a line end, and how many each piece has. plain: those
        without further white space."""
        a, n_of_a = self.a.spaced([p.encode("utf-8", "surrogatepass") for p in plain])
        other, n_of_other = _flat([np.frombuffer(x, "<u4") for x in self.a.each(rest)])
        # B puts a blank before what it is given, which no line end joins
        pieces = plain + rest
        b, n_of_b = _flat(self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1))
        own = np.array([p[0] != " " for p in pieces], bool)
        if own.any():
            kept = np.ones(len(b), bool)
            kept[(np.cumsum(n_of_b) - n_of_b)[own]] = False
            b, n_of_b = b[kept], n_of_b - own
        return np.concatenate([a.astype(np.int64), other]), np.concatenate([n_of_a, n_of_other]), b, n_of_b

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces; of one whose tokens' bytes aren't its own, groups has None."""
        plain = [p for p in pieces if _PLAIN(p)]
        rest = [p for p in pieces if not _PLAIN(p)] if len(plain) < len(pieces) else []
        pieces = plain + rest
        flat_a, n_of_a, flat_b, n_of_b = self._ids(plain, rest)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sums = lambda values, n: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(n)])])
        same = (sums(self.a_size[flat_a], n_of_a) == size) & (sums(self.b_size[flat_b], n_of_b) == size)
        whole = b"".join(raw)
        if not same.all() or b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) != whole:
            each = zip(np.split(flat_a, np.cumsum(n_of_a)[:-1]), np.split(flat_b, np.cumsum(n_of_b)[:-1]), raw, strict=True)
            same &= np.array([b"".join([self.a_bytes[x] for x in p.tolist()]) == r == b"".join([self.b_bytes[x] for x in q.tolist()]) for p, q, r in each], bool)
        flat_a, flat_b = flat_a[np.repeat(same, n_of_a)], flat_b[np.repeat(same, n_of_b)]
        right = np.flatnonzero(same)
        groups: list[str | None] = [None] * len(pieces)
        numbers, size = np.zeros((len(pieces), 4), np.int64), np.zeros(len(pieces), np.int64)
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(right):
            end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
            bits_a, bits_b = (Bits.of(e - 1, int(end_a[-1])) for e in (end_a, end_b))
            cuts = (bits_a & bits_b).select()
            to_a, to_b = bits_a.rank(cuts), bits_b.rank(cuts)
            from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
            # every piece ends in a shared cut
            owner = np.searchsorted(np.cumsum(n_of_a[right]), from_a, "right")
            n_a, n_b = to_a - from_a, to_b - from_b
            n_groups = np.bincount(owner, minlength=len(right))
            numbers[right] = np.stack([np.bincount(owner, n_a, len(right)), np.bincount(owner, n_b, len(right)), n_groups, np.bincount(owner, n_a * n_b, len(right))], 1).astype(np.int64)
            said = np.empty(len(flat_a) + len(flat_b), object)
            for flat, n, at, ends, words in ((flat_a, n_a, from_b, to_a, self.a_said), (flat_b, n_b, to_a, to_b, self.b_said)):
                own = words[0][flat]
                own[ends - 1] = words[1][flat[ends - 1]]
                said[np.arange(len(flat)) + np.repeat(at, n)] = own
            said = said.tolist()
            cut = [0, *np.cumsum(numbers[right, 0] + numbers[right, 1]).tolist()]
            for i, p, q in zip(right.tolist(), cut, cut[1:], strict=False):
                groups[i] = "".join(said[p:q])[:-1]
            who, keys, times = self._links(owner, flat_a, flat_b, from_a, n_a, from_b, n_b)
            size[right] = np.bincount(who, minlength=len(right))
        self.known.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces)), strict=True))
        self.groups += groups
        self.numbers = np.concatenate([self.numbers, numbers])
        self.first = np.concatenate([self.first, len(self.keys) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])

    @staticmethod
    def _links(owner, flat_a, flat_b, from_a, n_a, from_b, n_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, pair key, how often) of all links, ordered by piece."""
        product = n_a * n_b
        plain = np.flatnonzero(product <= EXPANDED)
        n = product[plain]
        group = np.repeat(plain, n)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        who = [owner[group]]
        keys = [pair_keys(flat_a[from_a[group] + nth // n_b[group]], flat_b[from_b[group] + nth % n_b[group]])]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(product > EXPANDED).tolist():
            a, many_a = np.unique(flat_a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
            b, many_b = np.unique(flat_b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
            who.append(np.full(len(a) * len(b), owner[g]))
            keys.append(pair_keys(np.repeat(a, len(b)), np.tile(b, len(a))))
            times.append(np.repeat(many_a, len(b)) * np.tile(many_b, len(a)))
        who, keys, times = np.concatenate(who), np.concatenate(keys), np.concatenate(times)
        order = np.argsort(who, kind="stable")
        return who[order], keys[order], times[order]

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all texts' pieces in the tables, which hold until places() is called again, and how many each has."""
        if len(self.groups) > REMEMBERED:
            self._age()
        cut = [cut_pieces(" " + t) if t else [] for t in texts]
        known, before = self.known, len(self.groups)
        fresh = {p for pieces in cut for p in pieces}.difference(known)
        if fresh:
            self.learn([*fresh])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        self.again = np.concatenate([self.again, np.zeros(len(self.groups) - len(self.again), bool)])
        self.again[flat[flat < before]] = True
        for p in fresh:
            if len(p) > LONGEST:
                del known[p]
        return flat, n

    def _age(self) -> None:
        """Forgets the pieces that weren't met again since they were learned or this was last done; all, if that leaves many."""
        kept = np.flatnonzero(self.again)
        if len(kept) > REMEMBERED // 2:
            self._forget()
            return
        place = np.full(len(self.groups), -1)
        place[kept] = np.arange(len(kept))
        self.known = {p: to for p, i in self.known.items() if (to := int(place[i])) >= 0}
        self.groups = [self.groups[i] for i in kept.tolist()]
        size = self.size[kept]
        link = np.repeat(self.first[kept] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.numbers, self.first, self.size = self.numbers[kept], np.cumsum(size) - size, size
        self.keys, self.times, self.again = self.keys[link], self.times[link], np.zeros(len(kept), bool)


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of lists, and how many each has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class _Block:
    """The alignments of a few texts: numbers, digests, and each one's distinct pairs by their place among the block's."""

    def __init__(self, aligner: Aligner, texts: list[str], whole: bool):
        flat, n = aligner.places(texts)
        row, every = np.repeat(np.arange(len(texts)), n), [*map(aligner.groups.__getitem__, flat.tolist())]
        cut = [0, *np.cumsum(n).tolist()]
        said = [every[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        void = np.array([None in s for s in said], bool)
        row, flat = row[~void[row]], flat[~void[row]]
        self.numbers = np.stack([np.bincount(row, aligner.numbers[flat, k], len(texts)) for k in range(4)]).astype(np.int64)
        joined = [None if None in s or not s else ";".join(s) for s in said]
        self.digests = ["" if s is None else hashlib.sha256(s.encode()).hexdigest() for s in joined]
        self.texts = [s or "" for s in joined] if whole else []
        size = aligner.size[flat]
        link = np.repeat(aligner.first[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        self.keys, at = np.unique(aligner.keys[link], return_inverse=True)
        spot = np.repeat(row, size) * np.int64(max(1, len(self.keys))) + at
        spot, own = np.unique(spot, return_inverse=True)
        self.times = np.bincount(own, aligner.times[link], len(spot)).astype(np.int64)
        holder, self.at = np.divmod(spot, max(1, len(self.keys)))
        self.sizes = np.bincount(holder, minlength=len(texts))
        self.held = np.bincount(self.at, minlength=len(self.keys))


def _blocks(doc_ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= BLOCK_ROWS or size + len(t) > BLOCK_CHARS):
            yield doc_ids[first:i], texts[first:i]
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield doc_ids[first:], texts[first:]


def align_tokenizers(docs: DataFrame, byte_file: str, piece_model: str, whole: bool = False) -> DataFrame:
    """Of every whole text: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is in as many documents
    as any pair of its A id), count_sum (documents of each link's pair, over links), groups_sha256, and groups if whole:
    `a1,a2|b1;a3|b2,b3`, the ids of A and B in each group.

    byte_file: a byte-level file of the tokenizers library; piece_model: a sentencepiece model with byte fallback, that
    puts a blank before a text and has no piece with a blank after another character, or with a line end. Special tokens'
    strings are plain text. Null and empty texts, and those whose tokens' bytes aren't a blank and the text (U+2581 in
    it), have no tokens: zeros and ''. Repeated rows and null ids count as documents each. Other columns aren't read. A
    very long text lies in a block of its own; of a long group without a shared cut, links of alike ids are counted
    together.
    Work: texts are aligned where they are read and never shuffled. Their pairs are written by blocks, each pair named
    once in a block, and go packed to parts of the A ids for the counts (packed.py), so a pair that every document holds
    comes once from each chunk of blocks.
    """
    chunks, parts = layout(docs)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = worker_held(("aligner", byte_file, piece_model), lambda: Aligner(byte_file, piece_model)), TaskContext.get().partitionId() * 7919
        names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
        lists, longs = pa.list_(pa.int64()), pa.list_(pa.string())
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.bool_(), *[lists] * 5, pa.list_(pa.int32()), pa.binary(), pa.binary(), longs, longs]
        for batch in batches:
            for ids, texts in _blocks(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]):
                b = _Block(aligner, texts, whole)
                wide = len(b.keys) > 1 << 16 or bool(len(b.times) and b.times.max() >= 1 << 16)
                kind = "<u4" if wide else "<u2"
                row = [number % chunks, b.keys.tobytes(), b.held.astype("<u4").tobytes(), wide, ids, *b.numbers, b.sizes, b.at.astype(kind).tobytes(), b.times.astype(kind).tobytes(), b.digests, b.texts]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    def own(table: pa.Table) -> pa.Table:
        """The chunk's pairs, each with its number of documents."""
        keys = np.concatenate([np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()])
        held = np.concatenate([np.frombuffer(h, "<u4") for h in table.column("held").to_pylist()])
        keys, at = np.unique(keys, return_inverse=True)
        told = np.zeros(len(keys), TOLD)
        told["n"], told["a"] = np.bincount(at, held, len(keys)), (keys >> np.uint64(32)).astype(np.uint32)
        return send(table.column("chunk")[0].as_py(), keys, told, parts, False)

    def counted(at: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's documents, doubled, and one more if no pair of its A id has more."""
        total = np.bincount(at, told["n"]).astype(np.int64)
        _, group = np.unique(told["a"], return_inverse=True)
        best = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
        np.maximum.at(best, group, total[at])
        return np.arange(len(at)), 2 * total[at] + (total[at] == best[group])

    def finished(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, values = received(answers, np.int64, False)
        out: dict[str, list] = {k: [] for k in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digests", "texts")}
        for row in range(table.num_rows):
            r = {c: table.column(c)[row].as_py() for c in table.column_names}
            kind = "<u4" if r["wide"] else "<u2"
            at, times = np.frombuffer(r["at"], kind), np.frombuffer(r["times"], kind).astype(np.int64)
            value = values[found(known, np.frombuffer(r["keys"], "<u8"))[1]][at] if len(known) else np.zeros(0, np.int64)
            owner, n = np.repeat(np.arange(len(r["sizes"])), r["sizes"]), len(r["sizes"])
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], owner, times * (value & 1))
            np.add.at(sums[1], owner, times * (value >> 1))
            out["n_best"] += sums[0].tolist()
            out["count_sum"] += sums[1].tolist()
            for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests"):
                out[c] += r[c]
            out["texts"] += r["texts"] or [None] * n
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=[f.split(" ")[0] for f in ALIGNED.split(", ")])

    blocks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of_batches(aligned), BLOCKS), "aligned")
    sent = blocks.select("chunk", "keys", "held").groupBy("chunk").applyInArrow(of_group(own), ROWS)
    told = answered(sent, np.dtype(TOLD), False, counted)
    out = blocks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(of_groups(finished), ALIGNED)
    return out if whole else out.drop("groups")
