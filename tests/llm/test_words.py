"""Hashes of words: words that a sum over powers of a base would take for one are told apart by every operator."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from finloom.llm import queries
from finloom.llm.lattice_lm import score_texts
from finloom.llm.ngram_join import link_near_duplicates
from finloom.llm.packed import distinct_pairs, found_pairs
from finloom.llm.storage import shared_folder
from finloom.llm.substrings import remove_repeats
from finloom.llm.token_files import read_token_files, write_token_files
from finloom.llm.words import byte_hashes, word_blocks

import pyarrow as pa


def twins(n):
    """A word of the Thue-Morse order of a and b, and its complement: polynomials of their bytes agree modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_twins_differ(n):
    (_, _, words), = word_blocks(pa.array([" ".join(twins(n))]), wide=True)
    assert words.hash[0] != words.hash[1] and words.second[0] != words.second[1]


def test_bytes_alone_decide():
    texts = ["abcdefgh", "x abcdefgh y", "\nabcdefgh", "abcdefg", "abcdefgh\x00", "abcdefghabcdefgh", "a" * 7, "a" * 8, "a" * 9, "é" * 20]
    of = {}
    for _, _, words in word_blocks(pa.array(texts * 2)):
        raw = words.raw.tobytes()
        for s, e, h in zip(words.start, words.end, words.hash, strict=True):
            of.setdefault(raw[s:e], set()).add(int(h))
    assert all(len(h) == 1 for h in of.values()) and len(set.union(*of.values())) == len(of)
    raw = np.frombuffer(b"0123456789abcdef" * 4, np.uint8)
    a, b = byte_hashes(raw, np.array([0, 16, 3]), np.array([16, 32, 19]), True)
    assert a[0] == a[1] != a[2] and b[0] == b[1] != b[2] and a[0] != b[0]
    assert len(byte_hashes(raw, np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_pairs_of_numbers():
    keys, seconds = np.array([5, 1, 5, 5, 9], np.uint64), np.array([2, 1, 1, 2, 0], np.uint64)
    k, s, place, at = distinct_pairs(keys, seconds)
    assert [*zip(k.tolist(), s.tolist(), strict=True)] == [(1, 1), (5, 1), (5, 2), (9, 0)] and (k[at] == keys).all() and (s[at] == seconds).all() and (keys[place] == k).all()
    there, where = found_pairs(k, s, np.array([5, 5, 5, 1, 2, 9, 10], np.uint64), np.array([2, 1, 3, 0, 1, 0, 0], np.uint64))
    assert there.tolist() == [True, True, False, False, False, True, False] and where[[0, 1, 5]].tolist() == [2, 1, 3]


def test_operators_tell_twins_apart(spark):
    a, b = twins(1024)
    window = " ".join(f"w{i}" for i in range(12))
    docs = [(0, f"x y z q {a}"), (1, f"x y z q {b}"), (2, f"{window} {a}"), (3, f"{window} {b}"), (4, a), (5, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert all(r["component_id"] == r["doc_id"] for r in link_near_duplicates(df).collect() if r["doc_id"] in (0, 1, 4, 5))
    assert all(r["n_removed"] == 0 for r in remove_repeats(df).collect())
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    folder = shared_folder(spark, "test")
    write_token_files(df, public_tokenizers.path(queries.VOCABULARY), folder, shards=1)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_token_files(spark, folder).collect()}
    assert got == {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in docs}
    scored = {r["doc_id"]: r for r in score_texts(df, public_tokenizers.path(queries.PIECES), df.doc_id == 5).collect()}
    assert scored[4]["n_known"] == 2 and scored[5]["n_known"] == 2 and scored[0]["train_tokens"] == 42
