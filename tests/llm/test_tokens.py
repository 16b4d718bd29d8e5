"""Token counts and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from finloom.llm import queries, token_counts, token_files
from finloom.llm.storage import shared_folder

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a\n", "\n", "\n\n a", "a  b", "a   b \n c\n\nd", "a\tb \t c", "don't we'll I'D it's",
    "the <|endoftext|> end<|endoftext|>", "<|endoftext|>", "Größe ñandú été 漢字かな交じり 🙂🙂 x", "12345 3.14 $%^&* ...!!! --", " x y   z",
    "a" * 3000, "ab" * 500 + " " + "word " * 2000, "x\r\ny\r\n\r\nz", "trailing   \n  ", "\x1c\x1d y \x85 z", "the the the", "the the the",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string").repartition(3)


def test_counts(docs, library):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library(t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512), t


def test_pack_round_trip():
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), np.random.default_rng(1).zipf(1.2, 70_000).clip(0, 2**31).astype(np.uint32), np.arange(70_001, dtype=np.uint32)):
        assert (token_files.unpack(len(ids), *token_files.pack(ids)) == ids).all()


def test_files(spark, docs, library, monkeypatch):
    folder = shared_folder(spark, "test")
    token_files.write_token_files(docs, public_tokenizers.path(queries.VOCABULARY), folder)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, folder).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*library(t), 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        start += len(ids)


def test_empty_and_ties(spark):
    schema = "doc_id long, text string"
    assert queries.token_file_digest(spark.createDataFrame([], schema)).collect() == []
    rows = queries.token_file_digest(spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (1, None)], schema)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 3, 3]
    assert rows[1]["ids_crc32"] == zlib.crc32(np.array([0], "<u4").tobytes())


@pytest.mark.parametrize("name", ["op6_token_files", "op9_token_counts"])
def test_whole_table(spark, library, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    start = 0
    for d in docs:
        ids, r = library(d["text"]), got[d["doc_id"]]
        if name == "op9_token_counts":
            assert (r["n_tokens"], r["n_bytes"]) == (len(ids), len(d["text"].encode()))
        else:
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
            start += len(ids) + 1


def test_frequent_words_stay_remembered():
    """Of more words met again than half of those remembered, the most frequent stay: few are asked for twice."""
    encoder, rng, asked = token_files.TextEncoder(public_tokenizers.path("byte_bpe_50k.json"), 100), random.Random(1), []
    plain = encoder.library.spaced
    encoder.library.spaced = lambda pieces: (asked.extend(pieces), plain(pieces))[1]
    texts = [" ".join(f"h{rng.randrange(20)}" if rng.random() < 0.6 else f"m{rng.randrange(70)}" if rng.random() < 0.8 else f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    got = [ids for t in texts for ids in encoder.of([t])]
    assert got == encoder.library.each(texts)
    assert sum(p.startswith(b" h") for p in asked) < 100


def test_memory_of_ids_is_given_back():
    """What reads files back keeps nothing of a block when it is done with it."""
    ids, ends = np.arange(1 << 18, dtype=np.uint32), np.arange(500, (1 << 18) + 500, 500).clip(0, 1 << 18)
    assert b"".join(token_files.id_arrays(ids, ends).to_pylist()) == ids.tobytes()
    assert token_files.id_arrays(ids[:0], np.array([0, 0])).to_pylist() == [b"", b""]

    def held() -> int:
        with open("/proc/self/status") as status:
            return next(int(line.split()[1]) for line in status if line.startswith("RssAnon")) // 1000

    before = held()
    for _ in range(300):
        token_files.id_arrays(token_files.unpack(len(ids), *token_files.pack(ids)), ends)
    assert held() - before < 150
