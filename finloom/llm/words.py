"""Words, their hashes and word shingles of whole Arrow batches of text, by numpy on the UTF-8 bytes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; a null text has no words.
Hashes have 64 bits and depend on the bytes alone, so that they agree between tasks and runs. Where a false match would
change a result, second has 64 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; temporaries take about 20 bytes for each.
BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Of the eight bytes read at a place, those that belong to a word of which so many are left.
_HELD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """64 bits of the bytes raw[start:end] of each word, and 64 more if wide: sums of every eight bytes, mixed with their
    place in the word before they are added up (weighed by place for the second), and the length."""
    size = end - start
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        total = mix(eight[start] & _HELD[np.minimum(size, 8)] ^ _STEP)
        other = total * _STEP if wide else None
        longer = np.flatnonzero(size > 8)
        if len(longer):
            n = -(-size[longer] // 8) - 1
            first = np.cumsum(n) - n
            nth = np.arange(1, int(n.sum()) + 1) - np.repeat(first, n)
            at = np.repeat(start[longer], n) + 8 * nth
            value = eight[at] & _HELD[np.minimum(np.repeat(end[longer], n) - at, 8)]
            place = mix(nth.astype(np.uint64) * _STEP)
            mixed = mix(value ^ place)
            total[longer] += np.add.reduceat(mixed, first)
            if wide:
                other[longer] += np.add.reduceat(mixed * (place | np.uint64(1)), first)
        length = size.astype(np.uint64) * _STEP
        return mix(total + length), mix(other ^ length) if wide else None


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the start of each row's text, with the end of the last; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def blocks(starts: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [first, last) of at most size bytes each, or of one longer row."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of the rows of a block.

    start, end: byte positions in the block; first: index of each row's first word, with the end of the last row's;
    ends: where each row's text ends;
    hash: 64 bits of each word's bytes; second: another 64 bits, if wide.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lower: bool = False, wide: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = np.empty(n + 1, bool)
        np.logical_not(_SEPARATOR[raw], out=inside[:n])
        inside[n] = False
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1]
        edge = starts[:-1][starts[:-1] < n]
        begins[edge] = inside[edge]
        ends = inside[:n] & ~inside[1:]
        last = starts[1:][starts[1:] > 0] - 1
        ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first, self.ends = np.searchsorted(self.start, starts), starts[1:]
        self.hash, self.second = byte_hashes(self.raw, self.start, self.end, wide)

    def runs(self, size: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """A hash of the size words from each word on, over row ends too; of hashes, if given, instead of hash."""
        hashes = self.hash if hashes is None else hashes
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out += hashes[k : k + n] * _PLACE[k]
        return mix(out)


def word_blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, wide: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, Words) for each block of a text column."""
    raw, starts = text_buffers(column)
    for a, b in blocks(starts):
        yield a, b, Words(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], lower, wide)


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row: of its runs of size words, or of all its words if fewer."""
    for a, b, words in word_blocks(column, lower):
        runs = words.runs(size)
        for i in range(b - a):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            if hi - lo >= size:
                yield np.unique(runs[lo : hi - size + 1])
            elif hi > lo:
                with np.errstate(over="ignore"):
                    yield mix(np.array([(words.hash[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) ^ np.uint64((hi - lo) * 0x9E3779B97F4A7C15 & (2**64 - 1))], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
