"""Key exchange between chunks of a corpus: many hashes in few rows.

Documents are dealt to chunks by a hash. A chunk sends its sorted distinct keys, packed, to the part of the key space
each belongs to; a part sees a key once for each chunk that holds it, however many rows do, and answers each chunk.
So a key that a third of all rows hold is no more work than others, and no row is made for a pair of documents.
Chunks and parts are as many as the texts' bytes ask for, so what a task holds at once doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import of_group, partitions

#: Bytes of a short key; with the part's number, a key has a false match in its part once in some thousands, which costs
#: work alone.
SHORT = 4
_LOW = np.uint64((1 << 8 * SHORT) - 1)

#: Chunks and parts for each of the session's shuffle partitions at least. A chunk sends a row to each part, so few are enough.
CHUNKS, PARTS = 2, 1
#: Bytes of text in a chunk, on average, at most; a part holds the keys of twice that.
CHUNK_BYTES = 256 << 20

ROWS = "part int, chunk int, keys binary, extra binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])


def layout(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
    """The numbers of chunks and of parts for docs, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(CHUNKS * partitions(docs.sparkSession), -(-size // chunk_bytes))
    return chunks, max(1, chunks * PARTS // CHUNKS)


def chunked(docs: DataFrame, n: int, *more: Column) -> DataFrame:
    """chunk, doc_id and text of docs, dealt to n chunks by id and text; more: further columns."""
    return docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(n)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key: the higher the key, the higher its part."""
    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def codes(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part and the short key of each key in one number; alike only for keys that count as the same."""
    return part(keys, parts) << np.uint64(8 * SHORT) | keys & _LOW


def _pack(keys: np.ndarray, short: bool) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes() if short else keys.astype("<u8").tobytes()


def unpack(raw: bytes, short: bool) -> np.ndarray:
    if not short:
        return np.frombuffer(raw, "<u8")
    out = np.zeros((len(raw) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").reshape(-1)


def send(chunk: int, keys: np.ndarray, extra: np.ndarray, parts: int, short: bool) -> pa.Table:
    """Rows to the parts. keys: sorted; extra: an array of as many values of any one type."""
    edges = np.concatenate([[0], np.searchsorted(part(keys, parts), np.arange(parts, dtype=np.uint64), "right")])
    full = np.flatnonzero(np.diff(edges))
    cut = [(edges[p], edges[p + 1]) for p in full]
    return pa.table([pa.array(full, pa.int32()), pa.array(np.full(len(full), chunk), pa.int32()), pa.array([_pack(keys[a:b], short) for a, b in cut], pa.binary()), pa.array([extra[a:b].tobytes() for a, b in cut], pa.binary())], schema=_SCHEMA)


#: The chunk number of a part's summary.
SUMMARY = -1


def answered(sent: DataFrame, kind: np.dtype, short: bool, answer: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], summary: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """sent with each part's answers instead: those keys a chunk is told of, with their new extra values.

    answer(at, extra): of all rows of a part, in the order of keys, the number of each one's distinct key, rising from
    0, and the chunks' values. It returns which rows are answered, and a value for each of these.
    summary: from the same, numbers of the part that make a row of their own, with SUMMARY as chunk.
    """

    def of_part(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        keys = [unpack(k, short) for k in table.column("keys").to_pylist()]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        extra = np.concatenate([np.frombuffer(e, kind) for e in table.column("extra").to_pylist()])
        whole = np.concatenate(keys)
        order = np.argsort(whole, kind="stable")
        ordered = whole[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        told, values = answer(np.cumsum(new) - 1, extra[order])
        rows = order[told]
        back = np.lexsort((rows, owner[rows]))
        rows, values = rows[back], values[back]
        edges = np.searchsorted(owner[rows], np.arange(len(keys) + 1))
        full = np.flatnonzero(np.diff(edges))
        number = table.column("part")[0].as_py()
        out = [(number, int(chunks[i]), _pack(whole[rows[edges[i] : edges[i + 1]]], short), values[edges[i] : edges[i + 1]].tobytes()) for i in full]
        if summary is not None:
            out.append((number, SUMMARY, b"", summary(np.cumsum(new) - 1, extra[order]).tobytes()))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)

    return sent.groupBy("part").applyInArrow(of_group(of_part), ROWS)


def received(table: pa.Table, kind: np.dtype, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's answers: the keys (codes() of them if short), sorted, and their values."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "keys", "extra")), strict=True))
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, kind)
    keys = np.concatenate([unpack(k, short) | np.uint64(p << 8 * SHORT if short else 0) for p, k, _ in rows])
    extra, order = np.concatenate([np.frombuffer(e, kind) for *_, e in rows]), np.argsort(keys)  # short keys aren't in order
    return keys[order], extra[order]


def found(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is there, and its place (any, if not)."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return sorted_keys[at] == wanted, at


def found_pairs(keys: np.ndarray, seconds: np.ndarray, wanted: np.ndarray, wanted_seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """found() for keys of 128 bits in two numbers; keys is sorted, and may repeat with other seconds."""
    is_there, at = found(keys, wanted)
    if len(keys):
        other = np.flatnonzero(is_there & (seconds[at] != wanted_seconds))
        for i in other.tolist():  # another key of the same first number, which hardly ever is
            run = np.flatnonzero(seconds[at[i] : np.searchsorted(keys, wanted[i], "right")] == wanted_seconds[i])
            is_there[i], at[i] = len(run) > 0, at[i] + (run[0] if len(run) else 0)
    return is_there, at


def _pair_order(keys: np.ndarray, seconds: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, second, values), and in it which ones begin another pair. Sorted by keys first, by both only where
    equal keys have other seconds."""
    order = np.lexsort((*values, keys)) if values else np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    for again in (False, True):
        k, s = keys[order], seconds[order]
        new[1:], other = k[1:] != k[:-1], s[1:] != s[:-1]
        if again or not (other & ~new[1:]).any():
            break
        order = np.lexsort((*values, seconds, keys))
    new[1:] |= other
    return order, new


def distinct_pairs(keys: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct (key, second), the place of one of each, and which of them each given one is."""
    order, new = _pair_order(keys, seconds)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    place = order[new]
    return keys[place], seconds[place], place, at


def first_values(keys: np.ndarray, seconds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct (key, second) and the least value of each."""
    order, new = _pair_order(keys, seconds, values)
    first = order[new]
    return keys[first], seconds[first], values[first]


def run_starts(flags: Sequence[bool] | np.ndarray) -> np.ndarray:
    """[start, end) of each run of true flags, as rows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
    return edge.reshape(-1, 2)
