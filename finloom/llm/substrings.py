"""Substring dedup: passages that an earlier document holds, found by difference-cover anchors.

An anchor is a run of words at a position whose remainder by PERIOD is in COVER. As every difference modulo PERIOD is
one of two members of COVER, two equal windows of ANCHOR + PERIOD - 1 words share an anchor at the same place in both,
wherever they stand. Anchors of one document alone are dropped; round each other one, the whole windows are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import ROWS, answered, chunked, codes, distinct_pairs, first_values, found, found_pairs, layout, received, run_starts, send
from .storage import of_group, of_groups
from .words import blocks, text_buffers, Words

#: A difference cover of 7.
PERIOD, COVER = 7, (0, 1, 3)

#: What stands for a null doc_id: no id is above it.
LAST = np.iinfo(np.int64).max

#: What a chunk tells of a window beside its 64-bit key: another 64 bits, and the smallest id that has it.
HELD = np.dtype([("second", "<u8"), ("id", "<i8")])

REMOVED = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"


class _Chunk:
    """The documents of a chunk: ids, and for each block of them its words and the row of each word."""

    def __init__(self, table: pa.Table, wide: bool = False):
        self.doc_id = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.ids = np.asarray(table.column("doc_id").fill_null(LAST).to_numpy()) if table.num_rows else np.zeros(0, np.int64)
        raw, starts = text_buffers(table.column("text"))
        self.raw, self.starts = raw, starts
        self.parts = [(a, b, Words(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], wide=wide)) for a, b in blocks(starts)]

    def runs(self, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: (hash, row, position in the row, another 64 bits if wide) of each run of size words inside a row."""
        out = []
        for a, _, words in self.parts:
            n = np.diff(words.first)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - words.first[:-1][row]
            whole = np.flatnonzero(place + size <= n[row])
            whole = whole[whole < max(0, len(words.hash) - size + 1)]
            out.append((words.runs(size)[whole], row[whole] + a, place[whole], words.runs(size, words.second)[whole] if words.second is not None else None))
        return out


def _number(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Of every whole text: doc_id, n_words, n_removed, kept (the words left, joined by single blanks) and removed (word
    ranges [start, end)).

    A word goes if a window of that many words over it also starts in a document with a smaller doc_id; all windows are
    judged on the input. A null id is larger than any other. Equal ids don't remove each other's words. Null and empty
    texts, and texts shorter than a window, keep all they have. A very long text lies whole in one chunk. Other columns
    aren't read.
    Windows are compared by 128 bits of two hashes. Work: the texts are dealt once to chunks; anchors and windows go
    packed between chunks (packed.py), windows only around anchors of several documents.
    """
    anchor = window - PERIOD + 1
    if anchor < 2:
        raise ValueError(f"a window has {PERIOD + 1} words at least")
    chunks, parts = layout(docs)
    dealt = chunked(docs, chunks)
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True

    def anchors(table: pa.Table) -> pa.Table:
        """The chunk's anchors, each with 1 if several of its documents have it."""
        keys, rows = [], []
        for key, row, place, _ in _Chunk(table).runs(anchor):
            held = in_cover[place % PERIOD]
            keys.append(key[held])
            rows.append(row[held])
        if not sum(map(len, keys)):
            return send(0, np.zeros(0, np.uint64), np.zeros(0, np.uint8), parts, True)
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(keys)) - 1
        return send(_number(table), keys[first], (rows[last] != rows[first]).astype(np.uint8), parts, True)

    def shared(at: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        told = np.flatnonzero((np.bincount(at) > 1)[at] | (np.bincount(at, several) > 0)[at])
        return told, np.zeros(len(told), np.uint8)

    def windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The windows round shared anchors, each with the chunk's smallest id that has it."""
        none = send(0, np.zeros(0, np.uint64), np.zeros(0, HELD), parts, False)
        if not table.num_rows or not answers.num_rows:
            return none
        chunk, (known, _) = _Chunk(table, True), received(answers, np.uint8, True)
        keys, seconds, ids = [], [], []
        for (key, row, place, _), (whole, whole_row, whole_place, second) in zip(chunk.runs(anchor), chunk.runs(window), strict=True):
            held = np.flatnonzero(in_cover[place % PERIOD])
            held = held[found(known, codes(key[held], parts))[0]]
            if not len(held) or not len(whole):
                continue
            # windows of a row stand together, so a window's place in the list is its row's first plus its position
            n = np.bincount(whole_row - whole_row[0], minlength=1)
            base = np.cumsum(n) - n
            near = np.zeros(len(whole) + 1, np.int64)
            r = row[held] - whole_row[0]
            ok = (r >= 0) & (r < len(n))
            r, p = r[ok], place[held][ok]
            low, high = np.maximum(p - (PERIOD - 1), 0), np.minimum(p + 1, n[r])
            ok = low < high
            np.add.at(near, base[r[ok]] + low[ok], 1)
            np.add.at(near, base[r[ok]] + high[ok], -1)
            picked = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            keys.append(whole[picked])
            seconds.append(second[picked])
            ids.append(chunk.ids[whole_row[picked]])
        if not keys:
            return none
        key, second, least = first_values(np.concatenate(keys), np.concatenate(seconds), np.concatenate(ids))
        held = np.zeros(len(key), HELD)
        held["second"], held["id"] = second, least
        return send(_number(table), key, held, parts, False)

    def earlier(at: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose window another chunk has with a smaller id, with the window's second number."""
        own = distinct_pairs(at, held["second"])[3]
        least = np.full(int(own.max()) + 1 if len(own) else 0, LAST)
        np.minimum.at(least, own, held["id"])
        told = np.flatnonzero(least[own] < held["id"])
        return told, held["second"][told]

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "removed": []}
        chunk, (known, known_second) = _Chunk(table, True), received(answers, np.uint64, False)
        runs = chunk.runs(window)
        none = np.zeros(0, np.uint64)
        keys, seconds, least = first_values(np.concatenate([k for k, *_ in runs]), np.concatenate([s for *_, s in runs]), np.concatenate([chunk.ids[r] for _, r, *_ in runs])) if runs else (none, none, np.zeros(0, np.int64))
        for (a, b, words), (key, row, place, second) in zip(chunk.parts, runs, strict=True):
            _, at = found_pairs(keys, seconds, key, second)
            gone = found_pairs(known, known_second, key, second)[0] | (least[at] < chunk.ids[row] if len(key) else np.zeros(0, bool))
            first = words.first[row[gone] - a] + place[gone]
            covered = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(covered, first, 1)
            np.add.at(covered, first + window, -1)
            covered = np.cumsum(covered[:-1]) > 0
            raw = words.raw.tobytes()
            for i in range(b - a):
                lo, hi = words.first[i], words.first[i + 1]
                gaps = run_starts(covered[lo:hi])
                out["n_words"].append(hi - lo)
                out["n_removed"].append(int(covered[lo:hi].sum()))
                text = raw[words.start[lo] : words.end[hi - 1]] if hi > lo and not len(gaps) else b" ".join(raw[s:e] for s, e in zip(words.start[lo:hi][~covered[lo:hi]].tolist(), words.end[lo:hi][~covered[lo:hi]].tolist(), strict=True))
                out["kept"].append((text if len(gaps) else b" ".join(text.split())).decode("utf-8", "replace"))
                out["removed"].append([{"start": int(s), "end": int(e)} for s, e in gaps])
        return pa.table([chunk.doc_id, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    by_chunk = dealt.groupBy("chunk")
    suspects = answered(by_chunk.applyInArrow(of_group(anchors), ROWS), np.dtype(np.uint8), True, shared)
    held = by_chunk.cogroup(suspects.groupBy("chunk")).applyInArrow(of_groups(windows), ROWS)
    told = answered(held, HELD, False, earlier)
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(of_groups(cut), REMOVED)
