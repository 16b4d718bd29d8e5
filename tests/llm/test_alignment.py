"""Alignment against a plain version: both libraries on whole texts, cuts as sets, all links in a list."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from finloom.llm import alignment, queries
from finloom.llm.alignment import Bits, align_tokenizers
from finloom.llm.token_counts import byte_letters

A, B = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.path(queries.PIECES)

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "\n\n a", "a\n", "a  b", "a   b \n c\n\nd", "a\tb \t c", "don't we'll I'D it's", "the <|endoftext|> end<|endoftext|>",
    "<s> </s> <unk> <0x41>", "Größe ñandú été 漢字かな交じり 🙂🙂 x", "é ﬁ    x \x1c\x1d y \x85 z", "a ▁b", "▁", "12345 3.14 $%^&* ...!!! --",
    "a" * 3000, "ab" * 500 + " " + "word " * 2000, "x\r\ny\r\n\r\nz", "trailing   \n  ", "a\x00b", "the the the", "the the the", "🙂" * 400, "ก" * 300 + "é" * 200,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b, of = SentencePieceProcessor(model_file=B), {letter: n for n, letter in enumerate(byte_letters())}

    def both(text):
        e = a.encode(" " + text, add_special_tokens=False)
        ids = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        return e.ids, [bytes(of[c] for c in t) for t in e.tokens], ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]

    return both


def groups(both, text):
    """The pairs (ids of A, ids of B) of a text's groups."""
    if not text:
        return []
    a, a_bytes, b, b_bytes = both(text)
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return []
    ends_a, ends_b = ([*np.cumsum([*map(len, x)]).tolist()] for x in (a_bytes, b_bytes))
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def brute(both, docs):
    held = [groups(both, t) for _, t in docs]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in held]
    count = Counter(p for own in links for p in set(own))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (d, _), g, own in zip(docs, held, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if g else "", said))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_bits():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        at = np.flatnonzero(rng.random(n) < 0.3)
        bits = Bits.of(at, n)
        assert bits.select().tolist() == at.tolist()
        assert bits.rank(np.arange(n)).tolist() == np.cumsum(np.isin(np.arange(n), at)).tolist()
        other = np.flatnonzero(rng.random(n) < 0.5)
        assert (bits & Bits.of(other, n)).select().tolist() == sorted({*at.tolist()} & {*other.tolist()})


def test_what_the_pieces_take_for_granted():
    b = SentencePieceProcessor(model_file=B)
    assert not any("▁" in p.lstrip("▁") or "\n" in p for p in map(b.id_to_piece, range(b.get_piece_size())))


def test_cases(spark, libraries):
    docs = [*enumerate(TEXTS), (3, "the the the"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, keys string, n_a int").repartition(3)
    got = sorted((tuple(r) for r in align_tokenizers(df, A, B, True).select(*COLUMNS, "groups").collect()), key=str)
    want = brute(libraries, docs)
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_long_groups(monkeypatch):
    texts = [t for t in TEXTS if t]
    blocks = []
    for expanded in (alignment.EXPANDED, 2):
        monkeypatch.setattr(alignment, "EXPANDED", expanded)
        blocks.append(alignment._Block(alignment.Aligner(A, B), texts, True))
    one, other = blocks
    assert all((getattr(one, k) == getattr(other, k)).all() for k in ("numbers", "keys", "at", "times", "held")) and one.texts == other.texts


def test_little_memory(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 3000)
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    aligner = alignment.Aligner(A, B)
    said = []
    for ids, texts in alignment._blocks([d for d, _ in docs], [t or "" for _, t in docs]):
        block = alignment._Block(aligner, texts, True)
        said += zip(ids, block.texts, strict=True)
    assert sorted(said) == sorted((d, s) for d, *_, s in brute(libraries, docs))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, libraries, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_align_tokenizers"](spark, folder).select(*COLUMNS).collect()), key=str)
    assert got == [w[:-1] for w in brute(libraries, docs)]
