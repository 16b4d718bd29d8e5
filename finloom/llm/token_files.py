"""Token-id files: ids ranked by frequency, one to four bytes each, lengths apart in control bytes.

A file is a Parquet table of blocks. A block holds whole documents in ascending doc_id order: their doc_ids and numbers
of ids, `ranked` (the block's distinct ids, most frequent first, 4 bytes each), `control` (two bits for each id: bytes
of its rank less one, four to a byte from the low bits) and `data` (the ranks' bytes, lowest first). shard and block
number the blocks; first counts the ids of the shard before the block.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packed import distinct_pairs, found_pairs
from .pieces import PieceValues
from .storage import of_batches, partitions, worker_held
from .words import mix, word_blocks

#: Ids after which a block is closed; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Rows that are encoded at once.
ROWS = 500

BLOCKS = "shard int, block int, first long, n_ids long, doc_ids array<long>, lengths array<long>, ranked binary, control binary, data binary"

#: Bytes of each of the four ids that a control byte tells.
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of ids."""
    if len(ids) and ids.max() < 1 << 22:  # the ids of any vocabulary: counted by place
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        counts = counts[distinct]
    else:
        distinct, counts = np.unique(ids, return_counts=True)
    order = np.lexsort((distinct, -counts))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    table = np.zeros(int(distinct[-1]) + 1 if len(distinct) and distinct[-1] < 1 << 22 else 0, np.uint32)
    if len(table):
        table[distinct] = place
        ranks = table[ids]
    else:
        ranks = place[np.searchsorted(distinct, ids)]
    sizes = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = sizes
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= sizes[:, None]]
    return distinct[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The n ids of pack()."""
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(sizes > k)
        ranks[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[ranks]


def id_arrays(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """ids cut at ends, 4 bytes each. The array stands on the ids' own bytes: made of memoryviews, pyarrow keeps them for good."""
    if 4 * len(ids) >= 1 << 31:
        raise ValueError("a document has 2^29 ids or more")
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])


class ByteLibrary:
    """Ids of pieces by the tokenizers library: of many pieces that follow each other safely in one call."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder()
        held = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(held.values(), default=0) + 1, np.int64)
        for token, i in held.items():  # a byte-level token has a letter for each byte
            self.bytes[i] = len(token.encode()) if i in added else len(token)

    def each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def spaced(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has. A piece is a blank or line end and then other
        characters than white space, so that many can be given to the library as one text."""
        ids, sizes = [], []
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            own = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends, wanted = np.cumsum(self.bytes[own]), np.cumsum([*map(len, part)])
            edges = np.searchsorted(ends, wanted)
            if len(own) and ends[-1] == wanted[-1] and (ends[np.minimum(edges, len(ends) - 1)] == wanted).all():
                sizes.append(np.diff(edges, prepend=-1))
            else:  # the vocabulary changes the text first
                each = self.each([p.decode() for p in part])
                own = np.frombuffer(b"".join(each), "<u4")
                sizes.append(np.array([len(x) // 4 for x in each], np.int64))
            ids.append(own)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def find(self, pieces: list[str]) -> list[bytes]:
        safe = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] in " \n" and not any(map(str.isspace, p[1:]))]
        rest = sorted({*range(len(pieces))}.difference(safe))
        out: list[bytes] = [b""] * len(pieces)
        for i, ids in zip(rest, self.each([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        ids, sizes = self.spaced([pieces[i].encode() for i in safe])
        raw, cut = ids.tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
        for i, a, b in zip(safe, cut, cut[1:], strict=False):
            out[i] = raw[a:b]
        return out


class TextEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct word that is remembered.

    In a text whose words stand between single blanks or line ends, a byte-level pre-tokenizer ends a token before each
    of these, so a word with the one before it has ids of its own. Such words are found by two hashes of their bytes, 128
    bits together, in sorted arrays (about 50 bytes for a word); other texts go by pieces (pieces.py).
    """

    def __init__(self, vocabulary: str, most: int = 200_000):
        self.library, self.most = ByteLibrary(vocabulary), most
        self.pieces = PieceValues(self.library.find, most // 4)
        self._forget()

    def _age(self) -> None:
        """Forgets the words that weren't met again since they were learned or this was last done; if that leaves more than
        half of the most, those met least often too."""
        kept, half = np.flatnonzero(self.again), self.most // 2
        if len(kept) > half:
            kept = np.sort(kept[np.argsort(self.again[kept], kind="stable")[len(kept) - half :]])
        size = self.size[kept].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[kept] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.known, self.second, self.at, self.size = self.known[kept], self.second[kept], ends - size, self.size[kept]
        self.again = self.again[kept] >> np.uint32(1)

    def _forget(self) -> None:
        self.known, self.second, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.again = np.zeros(0, np.uint32)  # batches that met a word again
        self.ids, self.used = np.zeros(1 << 16, np.uint16 if len(self.library.bytes) <= 1 << 16 else np.uint32), 0

    def _learn(self, keys: np.ndarray, seconds: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, spaced: np.ndarray) -> None:
        """Learns the words raw[start:end]; of those spaced, with the byte before them."""
        ids, sizes = self.library.spaced([raw[s:e] for s, e in zip((start[spaced] - 1).tolist(), end[spaced].tolist(), strict=True)])
        alone = self.library.find([raw[s:e].decode() for s, e in zip(start[~spaced].tolist(), end[~spaced].tolist(), strict=True)])
        ids = np.concatenate([ids, np.frombuffer(b"".join(alone), "<u4")])
        sizes = np.concatenate([sizes, np.array([len(b) // 4 for b in alone], np.int64)]).astype(np.int32)
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        keys, seconds = keys[order], seconds[order]
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        whole = np.concatenate([self.known, keys])
        order = np.argsort(whole, kind="stable")
        self.known, self.second = whole[order], np.concatenate([self.second, seconds])[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, sizes])[order]
        self.again = np.concatenate([self.again, np.zeros(len(keys), np.uint32)])[order]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without white space but single blanks and line ends between words."""
        out = []
        for first, last, words in word_blocks(pa.array(texts, pa.string()), wide=True):
            before = np.where(words.start > 0, words.raw[np.maximum(words.start - 1, 0)], 0).astype(np.uint64)
            before[words.first[:-1][words.first[:-1] < len(before)]] = 0  # nothing stands before a text's first word
            keys, seconds, place, at = distinct_pairs(mix(words.hash + (before << np.uint64(56))), words.second)
            held, spot = found_pairs(self.known, self.second, keys, seconds)
            self.again[spot[held]] += 1
            if len(self.known) + len(keys) - int(held.sum()) > self.most:
                self._age()
                held = found_pairs(self.known, self.second, keys, seconds)[0]
            lacking = np.flatnonzero(~held)
            if len(lacking):
                new = place[lacking]
                self._learn(keys[lacking], seconds[lacking], words.raw.tobytes(), words.start[new], words.end[new], before[new] > 0)
            spot = found_pairs(self.known, self.second, keys, seconds)[1]
            sizes, begin = self.size[spot][at].astype(np.int64), self.at[spot][at]
            ends = np.cumsum(sizes)
            ids = self.ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
            edges = np.concatenate([[0], ends])[words.first]
            out += [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        odd = [i for i, t in enumerate(texts) if _odd(t)]
        plain = sorted({*range(len(texts))}.difference(odd))
        out = [b""] * len(texts)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
            out[i] = ids.astype("<u4").tobytes()
        for i, values in zip(odd, self.pieces.of([texts[i] for i in odd]), strict=True):
            out[i] = b"".join(values)
        return out


def _odd(text: str) -> bool:
    """Whether a text has white space at its ends, two of it together, or other than blanks and line ends."""
    words, marks = text.split(), text.count(" ") + text.count("\n")
    return len(words) != marks + 1 or sum(map(len, words)) + marks != len(text) if words else bool(text)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, shards: int | None = None, remembered: int = 200_000) -> None:
    """Writes the ids of every whole text, each followed by end_id, in ascending doc_id order (null first, ties by text).

    vocabulary: path of a byte-level BPE file for the tokenizers library. A null text is empty: its end_id alone.
    An empty table gives a table without blocks. Repeated rows are all written; other columns aren't read. remembered: words
    whose ids a worker keeps, about 60 bytes each.
    Work: one range shuffle of the texts; a task holds a block and a batch at a time. Spark's committer makes a
    task that is run again replace its own files.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number, first = worker_held(("ids", vocabulary, remembered), lambda: TextEncoder(vocabulary, remembered)), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(b for _, b in held), "<u4")
            columns = [[shard], [number], [first], [len(ids)], [[d for d, _ in held]], [[len(b) // 4 for _, b in held]], *([x] for x in pack(ids))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "block", "first", "n_ids", "doc_ids", "lengths", "ranked", "control", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for doc_id, own in zip(part.column(0).to_pylist(), encoder.of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = own + end
                    if held and size + len(ids) // 4 > BLOCK_IDS:
                        yield block()
                        number, first, size = number + 1, first + size, 0
                        held.clear()
                    held.append((doc_id, ids))
                    size += len(ids) // 4
        if held:
            yield block()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards or partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(of_batches(encoded), BLOCKS).write.option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, 4 bytes each, lowest first).

    Starts come from one total for each shard, whose number is fixed when the files are written.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                start, n, doc_ids, lengths, *packed = (c[r].as_py() for c in batch.columns)
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - lengths
                ids = id_arrays(unpack(n, *packed), ends)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + starts), pa.array(lengths, pa.int64()), ids], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    placed = blocks.join(F.broadcast(starts), "shard").select((F.col("shard_start") + F.col("first")).alias("start"), "n_ids", "doc_ids", "lengths", "ranked", "control", "data")
    return placed.mapInArrow(of_batches(decoded), "doc_id long, start long, n_tokens long, ids binary")
