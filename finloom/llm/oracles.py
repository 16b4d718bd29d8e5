"""DuckDB SQL of those corpus queries that SQL can say."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from .urls import LABELLED, OFFSET_SHARE, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 11))) AS i FROM w)),
f AS (SELECT s, min(doc_id) AS m FROM x GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM x JOIN f USING (s) WHERE m < doc_id),
k AS (SELECT doc_id, list(j) AS l FROM c GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(len(l), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN l IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(l, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

BENCHMARK = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
q AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM d, (SELECT DISTINCT n FROM n))),
h AS (SELECT doc_id, item_id, i, n FROM q JOIN p USING (n, s)),
t AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN o USING (doc_id)"""


def _grams(url: str, n: int, buckets: int) -> list[int]:
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2]).groups()
    out = []
    for field, text in ((1, f"^{host.lower()}$"), (2, f"^{path}$")):
        for i in range(len(text) - n + 1):
            a = field
            for c in text[i : i + n]:
                a = a * 8191 + ord(c)
            out.append(a % 1_000_003 % buckets)
    return out


@lru_cache(maxsize=1)
def _weights(n: int = 3, buckets: int = 4096, rounds: int = 60, rate: float = 200.0) -> list[float]:
    """The regression of the labelled urls by plain gradient steps, which SQL alone can't take."""
    w, data = [0.0] * (buckets + 1), [(_grams(u, n, buckets), y) for u, y in LABELLED]
    for _ in range(rounds):
        misses = [y - 1 / (1 + math.exp(-(w[-1] + sum(w[b] for b in g) / len(g)))) for g, y in data]
        for e, (g, _y) in zip(misses, data, strict=True):
            for b in g:
                w[b] += rate / len(data) * e / len(g)
            w[-1] += rate / len(data) * e * OFFSET_SHARE
    return w


def urls() -> str:
    weights = _weights()
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in longest]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    grams = lambda t, field: f"list_transform(range(1, length({t}) - 1), lambda i: (((CAST({field} AS BIGINT) * 8191 + unicode({t}[i])) * 8191 + unicode({t}[i + 1])) * 8191 + unicode({t}[i + 2])) % 1000003 % 4096)"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT {weights[:-1]!r} AS w),
g AS (SELECT *, '^' || host || '$' AS a, '^' || path || '$' AS b FROM s),
z AS (SELECT *, list_concat({grams("a", 1)}, {grams("b", 2)}) AS l FROM g),
k AS (SELECT page_id, host, path, {weights[-1]!r} + coalesce(list_sum(list_transform(l, lambda x: w[x + 1])), 0) / greatest(len(l), 1) AS v FROM z, m)
SELECT page_id, host, path, {case([h + p for _, h, p in longest])} AS rule, coalesce({case([v for v, _, _ in longest])}, CASE WHEN v >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM k"""


ORACLES = {"op3_url_filter": urls(), "op8_decontaminate": BENCHMARK, "op10_substring_dedup": SUBSTRINGS}
