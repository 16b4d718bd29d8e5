"""URL filters against a plain version of the same rules and of the same regression."""

import math
import re

from finloom.llm import queries
from finloom.llm.urls import LABELLED, OFFSET_SHARE, RULES, judge_urls, labelled_urls, train


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def grams(url, n=3, buckets=4096):
    out = []
    for field, text in enumerate(parts(url), 1):
        text = f"^{text}$"
        for i in range(len(text) - n + 1):
            a = field
            for c in text[i : i + n]:
                a = a * 8191 + ord(c)
            out.append(a % 1_000_003 % buckets)
    return out


def learned(rows, rounds=60, rate=200.0, buckets=4096):
    w = [0.0] * (buckets + 1)
    data = [(grams(u), y) for u, y in rows]
    for _ in range(rounds):
        step = [0.0] * (buckets + 1)
        for g, y in data:
            e = y - 1 / (1 + math.exp(-(w[-1] + sum(w[b] for b in g) / len(g))))
            for b in g:
                step[b] += e / len(g)
            step[-1] += e * OFFSET_SHARE
        w = [a + rate / len(data) * s for a, s in zip(w, step, strict=True)]
    return w


def rule(host, path):
    fits = [(len(h + p), -i, h + p, v) for i, (v, h, p) in enumerate(RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_training(spark):
    got, want = train(labelled_urls(spark)), learned(LABELLED)
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-6
    assert train(labelled_urls(spark).limit(0)) == [0.0] * 4097


def test_rows(spark):
    w = learned(LABELLED)
    urls = [
        None, "", "no scheme/here", "://", "http://", "http://org/", "http://org", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://badexample.org/es/", "http://x.com/fr/://y",
        "http://x.com/de/1", "http://x.com/den", "http://Ünï.com/ä", "ftp://user@h:80/p;q?r", "http://casino-bets.net/win", "http://h#f/x", "http://h?q/x", "http://casino-bets.net/win", "http://x.net/a\nb",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    pages = pages.select("*").repartition(2)
    for r in judge_urls(pages, labelled_urls(spark)).collect():
        u = urls[r["page_id"]]
        host, path = parts(u)
        name, verdict = rule(host, path)
        g = grams(u)
        z = w[-1] + sum(w[b] for b in g) / max(1, len(g))
        assert (r["host"], r["path"], r["rule"]) == (host, path, name), u
        assert r["verdict"] == (verdict or ("block" if z >= 0 else "allow")), u
    assert judge_urls(pages.limit(0), labelled_urls(spark)).collect() == []


def test_whole_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op3_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = parts(pages[r["page_id"]])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name) and (not verdict or r["verdict"] == verdict)
    free = [r for r in got if r["rule"] is None]
    spam = [r for r in free if re.search("casino|bets|pills|spam|ads-|adult", r["host"])]
    assert spam and sum(r["verdict"] == "block" for r in spam) > 0.7 * len(spam)
    assert sum(r["verdict"] == "block" for r in free if r not in spam) < 0.02 * len(free)
