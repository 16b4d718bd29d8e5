"""Language identification: phrases against a search by substring, and accuracy on rows that are not learned from."""

import zlib

from finloom.llm import queries
import numpy as np

from finloom.llm.langid import LANE, CrossParser, _letters_only, identify, sample_texts


def phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i += max(1, j - 1 - i)
        n += 1
    return n


def test_phrases():
    samples = {"a": "The cat sat on the mat and the rat ran. " * 3 + "Über", "b": "Der Hund rannte über die Straße, und die Katze schlief. ñ"}
    texts = ["the hound ran over the mat", "Die Katze saß", "漢字 the cat 漢", "", "123 ?", "the cat\x00\x00sat " * 300, "éé über 🙂 𝒳𝒴 rat", "x"]
    counts, lettered = CrossParser(samples).phrases(texts)
    for text, row in zip(texts, counts, strict=True):
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        plain = " ".join(plain.split()) + (" " if plain.endswith(" ") and plain.strip() else "")
        assert [*row] == [phrases(plain, _letters_only(s)) for s in samples.values()], text
    assert [*lettered] == [True, True, True, False, False, True, True, True]


def test_long_texts():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdef "), 6)) for _ in range(300)]
    samples = {"a": " ".join(words[:200]), "b": " ".join(words[100:]), "c": "ab" * 900, "d": "fed cab"}
    texts = [" ".join(rng.choice(words, 3000)), samples["a"], samples["a"] * 3, "ab" * 2000, "ab" * 1700 + "c" + samples["b"], "a" * 4000, "x" * 3 * LANE, "", "ab"]
    plain = [_letters_only(t) + (" " if t.endswith(" ") and t.strip() else "") for t in texts]
    want = [[phrases(t, _letters_only(s)) for s in samples.values()] for t in plain]
    parser = CrossParser(samples)
    assert parser.phrases(texts)[0].tolist() == want == parser.phrases(texts, 7)[0].tolist()
    assert parser.phrases(texts[::-1], 64)[0].tolist() == want[::-1]


def test_many_letters():
    # two scripts of 4,000 letters: each letter of the samples counts, however rare
    rng = np.random.default_rng(6)
    words = {k: ["".join(map(chr, rng.integers(base, base + 4000, 2))) for _ in range(3000)] for k, base in (("x", 0x4E00), ("y", 0x20000))}
    parser = CrossParser({k: "".join(w) for k, w in words.items()})
    assert len(parser.letters) > 5000
    texts = ["".join(rng.choice(words[k], 40)) for k in "xyxy"]
    counts, _ = parser.phrases(texts)
    for text, row in zip(texts, counts, strict=True):
        assert [*row] == [phrases(text, "".join(w)) for w in words.values()]
    names, score = parser.predict(texts)
    assert names == ["x", "y", "x", "y"] and min(score) > 0.3


def test_copies_and_bounds(spark):
    one = "der Hund rannte über die Straße und die Katze schlief"
    rows = [(one, "de")] * 20_000 + [(f"the cat {i} sat on mat {i * 7}", "en") for i in range(2000)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    samples = sample_texts(labelled, 8_000, 4_000)
    assert samples["de"] == one and 3_500 <= len(samples["en"]) <= 4_000
    assert sample_texts(labelled.repartition(7), 8_000, 4_000) == samples and len(sample_texts(labelled, 8_000, 10)["de"]) == 10
    docs = spark.createDataFrame([(1, "die Katze rannte"), (2, "the cat sat")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["lang_pred"]) for r in identify(docs, labelled).collect()) == [(1, "de"), (2, "en")]


def test_cases(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "?! 12", "de"), (4, "the house and the garden", None), (4, "the house and the garden", None), (None, "das Haus und der Garten", None)]
    learn = spark.createDataFrame([("the house and the garden are in the town", "en"), ("das Haus und der Garten sind in der Stadt", "de"), (None, "fr"), ("x y", None), ("123", "es")], "text string, lang string")
    got = identify(spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double"), learn).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("None", "de")]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learn.limit(0)).collect()} == {"und"}
    assert identify(spark.createDataFrame([], "doc_id long, text string"), learn).collect() == []


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.98 * len(held)
