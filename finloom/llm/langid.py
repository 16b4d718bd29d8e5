"""Language identification by cross-parsing: the language whose sample spells a text in the fewest phrases wins.

A phrase is the longest match, from where the last one ended, in a sample of labelled text. A suffix automaton of each
sample finds it in one step a character. The driver builds the automata once and packs their transitions into one array
that all workers read; its size is bounded by the samples'.
Texts are parsed in lanes of LANE characters, one step of numpy for the n-th character of every lane. A lane starts as if
a phrase ended before it; then those that don't start a text are parsed again from the state that the lane before left,
until both ways are in the same state, which soon they are. So counts are those of a parse of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import of_batches, row_column, with_row

LANE = 512
#: Characters that are parsed together.
BLOCK_CHARS = 1_000_000

UNKNOWN = "und"


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of an id as text has that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def sample_texts(labelled: DataFrame, total_chars: int, row_chars: int) -> dict[str, str]:
    """Text of each lang, total_chars of all together shared evenly (500 of each at least): distinct texts in the order of
    their hashes, row_chars of each at most.

    labelled: lang and text. Rows, texts and languages that are null or hold no letter are left out. Copies of a text
    count once, so a language is learned however often one text of it is repeated. The driver gets a few rows for each
    language, then about twice the characters wanted: rows below a mark on the hashes that their distinct texts suggest.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, row_chars).alias("text"))
    # level n: texts whose hashes are below 2**(63 - n), about half of those of level n - 1
    level = F.lit(62) - F.floor(F.log2(F.greatest(F.col("h").bitwiseAND(F.lit((1 << 63) - 1)), F.lit(1)).cast("double"))).cast("int")
    marked = rows.withColumn("level", F.greatest(level, F.lit(0)))
    sizes = marked.groupBy("lang", "h", "level").agg(F.max(F.length("text")).alias("size")).groupBy("lang", "level").agg(F.sum("size").alias("size")).collect()
    if not sizes:
        return {}
    chars = max(500, total_chars // len({r["lang"] for r in sizes}))
    least: dict[str, int] = {}
    held: dict[str, int] = {}
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if held.get(r["lang"], 0) < chars:
            least[r["lang"]] = r["level"]
            held[r["lang"]] = held.get(r["lang"], 0) + r["size"]
    lowest = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))[F.col("lang")]
    picked = marked.where(F.col("level") >= lowest).select("lang", "h", "text").distinct()
    out: dict[str, list[str]] = {k: [] for k in least}
    for r in sorted(picked.collect(), key=lambda r: (r["h"] & ((1 << 63) - 1), r["h"], r["lang"], r["text"])):
        if sum(map(len, out[r["lang"]])) < chars:
            out[r["lang"]].append(r["text"])
    return {k: " ".join(v)[:chars] for k, v in sorted(out.items())}


def _letters_only(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of symbols by state; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for s in symbols:
        new = len(follow)
        follow.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and s not in follow[p]:
            follow[p][s] = new
            p = link[p]
        if p >= 0:
            q = follow[p][s]
            if longest[q] != longest[p] + 1:
                copy = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and follow[p].get(s) == q:
                    follow[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
                q = copy
            link[new] = q
        last = new
    return follow


def packed(follow: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, cells): state i owns cell places[i] + s for each symbol s it can follow; places are distinct.

    A cell holds the owner's place in its high half, that of the next state in its low half; others hold -1. States with
    several transitions are laid out first, those with one fill the gaps.
    """
    taken, places, used = bytearray(width), [0] * len(follow), bytearray()
    rows = sorted(range(len(follow)), key=lambda i: -len(follow[i]))
    several = sum(len(row) > 1 for row in follow)
    for part in (rows[:several], rows[several:]):
        at = 0
        for i in part:
            symbols = [*follow[i]]
            while True:
                if at >= len(used):
                    taken.extend(bytes(1 << 16))
                    used.extend(bytes(1 << 16))
                if not used[at] and not any(taken[at + s] for s in symbols):
                    break
                at += 1
            used[at], places[i] = 1, at
            for s in symbols:
                taken[at + s] = 1
            at += 1
    cells = np.full(max(places) + width + 1, -1, np.int64)
    for i, row in enumerate(follow):
        for s, to in row.items():
            cells[places[i] + s] = places[i] << 32 | places[to]
    return np.array(places, np.int64), cells


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class CrossParser:
    """samples: text by language. Symbol 0 is any run of characters other than letters, each letter of the samples has one
    of its own, and the last one is any letter that no sample has.

    languages, letters, starts (each language's first state), cells, home (the state after each symbol as the first of a
    phrase, or the start), lost (whether the language's sample lacks the symbol), scale (the cost of a phrase).
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        plain = {k: _letters_only(v) for k, v in samples.items()}
        self.letters = sorted({c for text in plain.values() for c in text if c != " "})
        number = {c: k + 1 for k, c in enumerate(self.letters)} | {" ": 0}
        self.other = len(self.letters) + 1
        width, k = self.other + 1, len(self.languages)
        self.starts, self.home, self.lost, parts, base = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.ones((k, width), bool), [], 0
        for i, language in enumerate(self.languages):
            follow = suffix_automaton([number[c] for c in plain[language]])
            places, cells = packed(follow, width)
            cells[cells >= 0] += base << 32 | base
            self.starts[i] = self.home[i] = places[0] + base
            for s, to in follow[0].items():
                self.home[i, s], self.lost[i, s] = places[to] + base, False
            parts.append(cells)
            base += len(cells)
        self.cells = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.scale = np.log2([max(2, len(plain[k])) for k in self.languages])
        self._numbers: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_numbers": None}

    def _symbols(self, lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols on end, and the number of each text's symbols."""
        if self._numbers is None:
            self._numbers = np.where(_alphabetic(), self.other, 0).astype(np.int32)
            self._numbers[[ord(c) for c in self.letters]] = np.arange(1, self.other)
        sizes = np.array([len(t) for t in lowered], np.int64)
        symbols = self._numbers[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = np.cumsum(sizes)
        before = np.zeros_like(symbols)
        before[1:] = symbols[:-1]
        before[(ends - sizes)[sizes > 0]] = 0
        kept = (symbols != 0) | (before != 0)
        total = np.concatenate([[0], np.cumsum(kept)])
        return symbols[kept], total[ends] - total[ends - sizes]

    def _step(self, state: np.ndarray, symbol: np.ndarray, ended: np.ndarray) -> np.ndarray:
        """The states after a symbol, languages by lanes; ended gets the phrases that end by it added."""
        cell = self.cells[state + symbol]
        out = cell & 0xFFFFFFFF
        row, lane = np.nonzero((cell >> 32) != state)
        if len(row):
            s = symbol[lane]
            ended[row, lane] += (state[row, lane] != self.starts[row]) + self.lost[row, s].astype(np.int64)
            out[row, lane] = self.home[row, s]
        return out

    def phrases(self, texts: list[str], lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """The number of phrases of each text in each language, and whether the text has a letter."""
        symbols, sizes = self._symbols([t.lower() for t in texts])
        ends = np.cumsum(sizes)
        lanes = -(-sizes // lane)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (ends - sizes)[owner] + nth * lane
        length = np.minimum(lane, ends[owner] - begin)
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(1, (int(length.max()) if len(length) else 0) + 1), "right")
        k, start = len(self.languages), self.starts[:, None]
        state, ended = np.repeat(start, len(owner), 1), np.zeros((k, len(owner)), np.int64)
        for t, n in enumerate(active):
            state[:, :n] = self._step(state[:, :n], symbols[begin[order[:n]] + t], ended[:, :n])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        state, ended = state[:, back], ended[:, back]  # by lane again
        again, more, alone = np.flatnonzero(nth > 0), np.zeros_like(ended), state.copy()
        while len(again):  # lanes whose entry isn't the start of a phrase, or not the one that was thought
            more[:, again] = 0
            entry, todo = state[:, again - 1], np.arange(len(again))
            apart, left, gain = entry.copy(), np.repeat(start, len(again), 1), np.zeros((2, k, len(again)), np.int64)
            t = 0
            while len(todo):
                at = symbols[begin[again[todo]] + t]
                counts = gain[:, :, todo]
                apart[:, todo] = self._step(apart[:, todo], at, counts[0])
                left[:, todo] = self._step(left[:, todo], at, counts[1])
                gain[:, :, todo] = counts
                t += 1
                todo = todo[(apart[:, todo] != left[:, todo]).any(0) & (length[again[todo]] > t)]
            more[:, again] = gain[0] - gain[1]
            exits = np.where(apart != left, apart, alone[:, again])
            changed = (exits != state[:, again]).any(0)
            state[:, again] = exits
            onward = again[changed] + 1
            again = onward[(onward < len(owner)) & (nth[np.minimum(onward, len(owner) - 1)] > 0)] if len(onward) else onward
        last = np.cumsum(lanes)[lanes > 0] - 1
        ended += more
        ended[:, last] += state[:, last] != start
        counts = np.stack([np.bincount(owner, ended[i], len(texts)) for i in range(k)], 1) if k else np.zeros((len(texts), 0))
        seen = np.concatenate([[0], np.cumsum(symbols != 0)])
        return counts, seen[ends] > seen[ends - sizes]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; score: the share of phrases by which the next best language needs more."""
        counts, lettered = self.phrases([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost = counts * self.scale
        best = cost.argmin(1)
        order = np.sort(cost, 1)
        score = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9) if len(self.languages) > 1 else np.ones(len(texts))
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def identify(docs: DataFrame, labelled: DataFrame, total_chars: int = 160_000, row_chars: int = 4_000, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text; with carry also row, all columns of docs in one.

    labelled: text and lang to learn from. The samples share total_chars characters, which bounds the automata (about 40
    bytes a character, broadcast); row_chars is the most that one labelled row gives. Nothing else is bounded: texts of
    any length are parsed whole, and letters and languages are as many as the samples hold.
    A text that is null or has no letter, and any text when nothing is learned, is `und` with score 0; equal costs go
    to the first language by name. Repeated rows and null ids give a row each. Other columns aren't read.
    Work: one pass over the texts, without a shuffle, after two over labelled, the first of which shuffles a hash for
    each distinct text.
    """
    held = docs.sparkSession.sparkContext.broadcast(CrossParser(sample_texts(labelled, total_chars, row_chars)))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held.value  # Spark keeps it in a worker for as long as its tasks name it
        for batch in batches:
            sizes = np.array(batch.column(1).to_pylist(), np.int64)
            cut = np.cumsum(sizes) // BLOCK_CHARS
            edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    texts = part.column(2).field("text") if carry else part.column(2)  # a row that is carried has its text
                    languages, scores = parser.predict(texts.to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), *part.columns[2 : 2 + carry]], ["doc_id", "lang_pred", "score", "row"][: 3 + carry])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), *(row_column(carry) or ["text"]))
    return read.mapInArrow(of_batches(parsed), with_row("doc_id long, lang_pred string, score double", docs, carry))
