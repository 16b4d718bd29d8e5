"""Fingerprints: entropies and features against a plain version, order and edits, and what likeness tells apart."""

import hashlib
import math
import random

import numpy as np
from collections import Counter

from finloom.llm import fingerprints as fp
from finloom.llm import queries


def entropy_step(window):
    return round((1 - sum(round(c * math.log2(c) * 4096) for c in Counter(window).values()) / round(64 * 6 * 4096)) * 1000)


def test_entropies():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdefgh zy") for _ in range(n)) for n in (64, 65, 1087, 1088, 3000)] + [b"a" * 200, bytes(range(256))]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([*map(len, texts)])
    got = fp.entropies(raw, np.cumsum(sizes) - sizes, sizes - 63)
    want = [entropy_step(t[i : i + 64]) for t in texts for i in range(len(t) - 63)]
    assert np.abs(got - np.array(want)).max() <= 1 and (got == np.array(want)).mean() > 0.99


def test_features():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"etaoin shrdlu") for _ in range(n)) for n in (0, 1, 63, 64, 100, 127, 140, 2500)]
    rank = np.array(rng.sample(range(1001), 1001), np.int32)
    got = fp._features(texts, rank)
    raw_rank = lambda t: [int(rank[s]) for s in fp.entropies(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t) - 63]))]
    for t, features in zip(texts, got, strict=True):
        if len(t) < 64:
            assert len(features) == (len(t) > 0)
            continue
        r = raw_rank(t)
        votes = Counter(min(range(i, i + 64), key=lambda j: (r[j], j)) for i in range(len(r) - 63)) or Counter({min(range(len(r)), key=lambda j: (r[j], j)): 99})
        need = min(16, max(1, len(r) - 63))
        assert len(features) == len({t[p : p + 64] for p, n in votes.items() if n >= need}), len(t)


def test_likeness():
    rng = random.Random(3)
    rank = np.arange(1001, dtype=np.int32)
    text = lambda n: bytes(rng.choice(b"etaoin shrdlucmfwyp") for _ in range(n))
    a, b = text(30_000), text(30_000)
    da, db, dc, de = fp.fingerprints([a, b, a[:20_000] + b[:10_000], b""], rank)
    assert fp.likeness(da, da) == 1 and fp.likeness(de, de) == 1 and fp.likeness(da, de) == 0
    assert fp.likeness(da, dc) > 0.4 and fp.likeness(da, db) < 0.1 and fp.likeness(da, dc) == fp.likeness(dc, da)


def test_only_empty_texts_have_no_feature():
    rng = random.Random(5)
    rank = np.array(rng.sample(range(1001), 1001), np.int32)
    texts = [bytes(rng.choice(b"etaoin shrdlu") for _ in range(n)) for n in range(127, 201)]
    texts += [bytes(rng.sample(range(97, 123), p)) * 2000 for p in range(1, 16)]
    digests = fp.fingerprints([*texts, b""], rank)
    assert all(digests[:-1]) and digests[-1] == b""
    for i, d in enumerate(digests):
        assert all(fp.likeness(d, e) < 1 for e in digests[:i])
    votes = fp._features(texts, rank)
    assert sum(not len(f) for f in votes) > 20  # those that the votes alone leave out
    for f, g in zip(votes, fp._features(texts, rank, some=True), strict=True):
        assert not len(f) or f.tolist() == g.tolist()
    # no window wins all stretches of this text: the most votes count, all that have them
    text = next(t for t, f in zip(texts, votes, strict=True) if len(t) < 142 and not len(f))
    r = rank[fp.entropies(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text) - 63]))].tolist()
    won = Counter(min(range(i, i + 64), key=lambda j: (r[j], j)) for i in range(len(r) - 63))
    assert len(fp._features([text], rank, some=True)[0]) == len({text[p : p + 64] for p, n in won.items() if n == max(won.values())})
    near = text[:-1] + b"#"
    assert fp.likeness(*fp.fingerprints([text, near], rank)) > 0
    many = b"ab" * 200_000  # more tied winners than are hashed together
    assert len(fp._features([many], rank, some=True)[0]) in (1, 2)


def test_order_and_edits(spark):
    rng = random.Random(4)
    docs = [(rng.choice([i, i * 1000, -i]), "".join(rng.choice("ab é🙂c ") for _ in range(rng.randrange(300)))) for i in range(1, 80)]
    docs += [(None, "null id"), (5, None), (5, ""), (5, "tie"), (5, "tie"), (10**12, "x" * 50_000)]
    low = lambda d: -(1 << 63) if d is None else d
    ordered = sorted(docs, key=lambda d: (-low(d[0]), (d[1] or "").encode()))
    want = []
    for (d, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        a, b = a or "", b or ""
        want.append((str(d), len(a), a[: len(a) - len(a) // 3] + b[: len(a) // 3]))
    got = fp.fingerprint_neighbours(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, bucket int").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"]) for r in got) == sorted(want)
    assert [r["edited"] for r in fp.fingerprint_neighbours(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).collect()] == ["abcdab"]
    assert fp.fingerprint_neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_fingerprints"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for (d, a), (_, b) in zip(docs, docs[1:] + docs[:1], strict=True):
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
    same = {}
    for d, t in docs:
        assert same.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    near, far = ([r[k] for r in got.values()] for k in ("near_edited", "near_next"))
    assert np.mean(near) > 0.4 and np.mean(far) < 0.15 and all(0 <= x <= 1 for x in near + far)
    print("near", np.quantile(near, [0.01, 0.05, 0.5]), "far", np.quantile(far, [0.5, 0.95, 0.99]))
