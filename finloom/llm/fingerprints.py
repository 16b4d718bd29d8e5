"""Document fingerprints: digests of improbable features.

Every window of WINDOW bytes has an entropy; windows whose entropy is rare in the corpus rank first. The window that
ranks first in a stretch of WINDOW neighbours gets a vote, and those with VOTES become features (where a text has none,
those with its most votes): their hashes set bits of a Bloom filter, and a new one is chained on after FEATURES of them.
Likeness is the overlap of the filters' bits, above what chance brings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import dealt_by_descending_id
from .words import mix

#: Fixed values of the format.
WINDOW, VOTES, FEATURES, FILTER_BYTES, HASHES, CUTOFF = 64, 16, 160, 256, 5, 0.3

#: Entropy is told in so many steps.
STEPS = 1000
#: Windows that a lane of work holds, and bytes that are worked on together.
LANE, BLOCK_BYTES = 1024, 2_000_000
#: Features that are hashed together: a text of short periods has nearly as many tied winners as bytes.
HASHED = 1 << 16

_COUNTS = np.arange(WINDOW + 1)
_WEIGHT = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * 4096).astype(np.int32)
_GAIN = np.diff(_WEIGHT)  # of one more of a byte of which there are so many
_STEP = np.round((1 - np.arange(_WEIGHT[-1] + 1) / _WEIGHT[-1]) * STEPS).astype(np.int16)
_FACTORS = mix(np.arange(11, 11 + WINDOW // 8, dtype=np.uint64)) | np.uint64(1)


def entropies(raw: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The entropy step of count windows each from begin on, all on end. One byte enters each lane's window at a time."""
    lanes = -(-count // LANE)
    owner = np.repeat(np.arange(len(begin)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = begin[owner] + nth * LANE
    windows = np.minimum(LANE, count[owner] - nth * LANE)
    order = np.argsort(-windows, kind="stable")
    start, sizes = start[order], windows[order]
    held = np.zeros(len(order) * 256, np.uint8)
    lane = np.arange(len(order)) * 256
    total = np.zeros(len(order), np.int32)
    out = np.zeros((len(order), LANE), np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -(np.arange(longest + WINDOW - 1) - (WINDOW - 1)).clip(0) - 1, "right")
    for t, n in enumerate(active):
        at = start[:n] + t
        if t >= WINDOW:
            i = lane[:n] + raw[at - WINDOW]
            c = held[i] - 1
            total[:n] -= _GAIN[c]
            held[i] = c
        i = lane[:n] + raw[at]
        c = held[i]
        total[:n] += _GAIN[c]
        held[i] = c + 1
        if t >= WINDOW - 1:
            out[:n, t - WINDOW + 1] = _STEP[total[:n]]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out = out[back]
    return out[np.arange(LANE) < windows[:, None]]


def _features(texts: list[bytes], rank: np.ndarray, some: bool = False) -> list[np.ndarray]:
    """The features' hashes of each text, in order, each once. Where no window has the votes: none, or with some those
    with the most, so that every text but an empty one has a feature."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= WINDOW)
    count = sizes[long] - WINDOW + 1
    out = [np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")] if t else [], np.uint64) for t in texts]
    if not len(long):
        return out
    ranks = rank[entropies(raw, begin[long], count)].astype(np.int64)
    first = np.cumsum(count) - count
    key = ranks << 32 | np.arange(len(ranks))
    least = key.copy()
    reach = 1
    while reach < WINDOW:
        least[:-reach] = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    inside = np.arange(len(key)) < np.repeat(first + count - WINDOW + 1, count)
    winners = least[inside] & 0xFFFFFFFF
    short = np.flatnonzero(count < WINDOW)
    votes = np.bincount(winners, minlength=len(key))
    if len(short):
        best = np.minimum.reduceat(key, first)[short] & 0xFFFFFFFF
        votes[best] = VOTES
    needed = np.minimum(VOTES, np.maximum(1, count - WINDOW + 1))
    if some:
        needed = np.minimum(needed, np.maximum.reduceat(votes, first))
    picked = np.flatnonzero(votes >= np.repeat(needed, count))
    owner = np.searchsorted(first, picked, "right") - 1
    place = begin[long][owner] + picked - first[owner]
    hashes = np.empty(len(place), np.uint64)
    for a in range(0, len(place), HASHED):
        with np.errstate(over="ignore"):
            eight = raw[place[a : a + HASHED, None] + np.arange(WINDOW)].view("<u8")
            hashes[a : a + HASHED] = mix((mix(eight) * _FACTORS).sum(1, dtype=np.uint64))
    edges = np.searchsorted(owner, np.arange(len(long) + 1))
    for i, k in enumerate(long):
        own = hashes[edges[i] : edges[i + 1]]
        out[k] = own[np.sort(np.unique(own, return_index=True)[1])]
    return out


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """The digest of each text: features in the last filter, then the filters; nothing for an empty text."""
    out = []
    for features in _features(texts, rank, some=True):
        if not len(features):
            out.append(b"")
            continue
        chain = np.arange(len(features)) // FEATURES
        bits = np.zeros((chain[-1] + 1) * FILTER_BYTES * 8, bool)
        for k in range(HASHES):
            bits[chain * FILTER_BYTES * 8 + (features >> np.uint64(11 * k) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = True
        out.append(bytes([len(features) - FEATURES * int(chain[-1])]) + np.packbits(bits).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: each filter of the shorter digest against the best of the other's. Two empty digests are alike, one isn't."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    if (len(a), a) > (len(b), b):
        a, b = b, a
    x, y = (np.frombuffer(d, np.uint8, offset=1).reshape(-1, FILTER_BYTES) for d in (a, b))
    full = np.bitwise_count(y).sum(1, dtype=np.int64)
    weights = np.full(len(x), FEATURES)
    weights[-1] = a[0]
    total = 0.0
    for row, weight in zip(x, weights, strict=True):
        own = int(np.bitwise_count(row).sum(dtype=np.int64))
        most = np.minimum(own, full)
        floor = own * full / (FILTER_BYTES * 8)
        floor = floor + CUTOFF * (most - floor)
        common = np.bitwise_count(y & row).sum(1, dtype=np.int64)
        total += weight * float(np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / float(weights.sum())


def rarity_ranks(docs: DataFrame) -> list[int]:
    """For each entropy step its rank among all, the rarest in the windows of all texts first, ties by step."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for texts in _parts([t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist() if t]):
                sizes = np.array([len(t) for t in texts], np.int64)
                long = np.flatnonzero(sizes >= WINDOW)
                if len(long):
                    total += np.bincount(entropies(np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(sizes) - sizes)[long], sizes[long] - WINDOW + 1), minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(total)], ["step", "n"])

    counts = docs.select("text").mapInArrow(counted, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(STEPS + 1, np.int64)
    for r in counts:
        n[r["step"]] = r["n"]
    out = np.empty(STEPS + 1, np.int64)
    out[np.lexsort((np.arange(STEPS + 1), n))] = np.arange(STEPS + 1)
    return out.tolist()


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        if held and size + len(t) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


FINGERPRINTS = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Of every whole text (null: empty): doc_id, n_chars, its fingerprint, and those of its neighbour in descending
    doc_id (null last, equal ids by text; after the last row the first): edited is the text with its last third
    replaced by as much of the neighbour's beginning, near_edited and near_next are the likeness to edited and to the
    neighbour.

    A text of fewer bytes than a window is one feature. A single row is its own neighbour. Repeated rows give a row
    each; other columns aren't read. Work: a pass over the texts for the ranks, then one shuffle that deals them by
    ranges of ids, with one row more for each range.
    """
    ranks = rarity_ranks(docs)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.array(ranks, np.int32)

        def rows(held: list[tuple]) -> pa.RecordBatch:
            """held: (doc_id, text, n_chars, bucket, ahead) in order, all of one bucket; the last only follows."""
            raw = [t.encode("utf-8", "surrogatepass") for _, t, *_ in held]
            edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for (_, a, *_), (_, b, *_) in zip(held, held[1:], strict=False)]
            changed = [t.encode("utf-8", "surrogatepass") for t in edited]
            own, other = fingerprints(raw, rank), fingerprints(changed, rank)
            text = lambda d: base64.b64encode(d).decode()
            columns = [
                pa.array([h[0] for h in held[:-1]], pa.int64()), pa.array([h[2] for h in held[:-1]], pa.int64()), pa.array(edited, pa.string()),
                pa.array(map(text, own[:-1]), pa.string()), pa.array(map(text, other), pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[-1][4]:  # what follows the bucket has come
                    if row[3] == held[-1][3]:
                        continue
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
                if len(held) > 1 and (row[4] or size > BLOCK_BYTES):
                    yield rows(held)
                    held, size = held[-1:], len(row[1])

    return dealt_by_descending_id(docs).mapInArrow(compared, FINGERPRINTS)
