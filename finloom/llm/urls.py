"""URL filters: host and path rules, else logistic regression on hashed character n-grams, in Spark SQL alone.

The regression is trained by gradient steps in SQL over a small labelled table; its weights, one for each bucket and
one for all, are then a constant of the scoring expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Labelled addresses, 1 to block.
LABELLED = (
    ("http://cheap-casino-bonus.example/play", 1), ("https://best-poker-bets.example/en/win", 1), ("http://free-slots.example/spin", 1), ("https://www.casino-royal.example/de/12", 1),
    ("http://bet-now.example/odds.html", 1), ("https://m.sports-bets.example/live", 1), ("http://lucky-win.example/jackpot", 1), ("https://win-money.example/fr/7", 1),
    ("http://pills-online.example/order", 1), ("https://cheap-pharma-pills.example/en/44", 1), ("http://discount-meds.example/buy", 1), ("http://www.pills-shop.example/cart", 1),
    ("http://spam-offers.example/click", 1), ("http://content-farm.example/articles", 1), ("https://spam-mail.example/en/16", 1), ("https://blog.spam-links.example/en/1", 1), ("http://link-farm.example/page", 1), ("http://seo-spam.example/es/90.html", 1),
    ("https://ads-click.example/banner", 1), ("http://m.ads-server.example/track?id=7", 1), ("http://click-track.example/r", 1), ("https://track-ads.example/en/5", 1),
    ("http://adult-videos.example/watch", 1), ("https://xxx-adult.example/en/8", 1), ("http://www.adult-cams.example/live", 1), ("http://hot-xxx.example/girls", 1),
    ("http://free-download-crack.example/keygen", 1), ("https://warez-crack.example/serial", 1), ("http://free-gifts.example/claim", 1), ("https://cheap-loans.example/fast", 1),
    ("https://news.example/world/article", 0), ("https://www.daily-report.example/en/204", 0), ("http://library.example/catalog", 0), ("https://blog.gardening.example/spring", 0),
    ("https://university.example/research/paper", 0), ("http://www.cityhall.example/de/21", 0), ("https://docs.project.example/guide/", 0), ("http://m.weather.example/fr/9", 0),
    ("https://museum.example/en/exhibition.html", 0), ("http://history.example/es/300", 0), ("https://www.recipes.example/bread", 0), ("http://blog.travel.example/en/77?page=2", 0),
    ("https://science.example/journal/12", 0), ("http://school.example/class", 0), ("https://www.thereading.example/en/618", 0), ("http://theater.example/program#top", 0),
    ("https://another-station.example/fr/55/", 0), ("http://www.nation.example/en/150", 0), ("https://translation.example/de/3", 0), ("http://m.therapist.example/en/40", 0),
    ("https://blog.weather-station.example/en/31.html", 0), ("http://www.music-review.example/es/18", 0), ("https://open-source.example/fr/6", 0), ("http://health-institute.example/en/2", 0),
    ("https://encyclopedia.example/wiki/Page", 0), ("http://www.court.example/decision/99", 0), ("https://forum.example/thread/12/", 0), ("http://photo-archive.example/en/870", 0),
)

#: Most rows and most rules that are taken; both become part of one expression.
MOST_LABELLED, MOST_RULES = 2_000, 1_000


def split_url(url: str) -> tuple[Column, Column]:
    """(host, path) of a url column: host between the first :// and the next of / ? #, with A-Z lower-cased; path from
    there up to ? or #. Null, or without ://: both empty."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule, written host and path together, that fits; ties go to the first; else null.

    A rule fits its host and what ends in . and its host, where the path starts with the rule's.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} make one expression")
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in longest]), pick([v for v, _, _ in longest])


def _grams(text: Column, n: int, field: int, buckets: int) -> Column:
    """The bucket of each run of n characters of text: a sum of code points by place, the field apart."""
    code = lambda i, k: F.ascii(F.substr(text, i + k, F.lit(1))).cast("long")
    runs = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(runs, lambda i: F.pmod(reduce(lambda a, k: a * 8191 + code(i, k), range(n), F.lit(field).cast("long")), F.lit(1_000_003)) % buckets)


def features(host: Column, path: Column, n: int, buckets: int) -> Column:
    """Buckets of the n-grams of host and of path, each between marks, as long as there is a host or path."""
    return F.concat(_grams(F.concat(F.lit("^"), host, F.lit("$")), n, 1, buckets), _grams(F.concat(F.lit("^"), path, F.lit("$")), n, 2, buckets))


def _logit(weights: Column, buckets: Column) -> Column:
    """The last weight plus the mean of the buckets' weights."""
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(weights, b.cast("int")))
    return F.get(weights, F.size(weights) - 1) + total / F.greatest(F.size(buckets), F.lit(1))


#: What a round adds to the weight for all against what it adds to a bucket's.
OFFSET_SHARE = 0.01


def train(labelled: DataFrame, n: int = 3, buckets: int = 4096, rounds: int = 60, rate: float = 200.0) -> list[float]:
    """Weights of the buckets and a last one for all, from url and label (1 to block).

    Each round is a gradient step over all rows. The weights are a sum of rows times factors, so the factors are
    stepped (one number a row, by the rows' products) and the weights summed at the end. Repeated rows count as often.
    Rows with a null are left out; without rows all weights are 0. At most MOST_LABELLED rows, else ValueError.
    """
    host, path = split_url("url")
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select(F.col("label").cast("double").alias("y"), features(host, path, n, buckets).alias("b"))
    if (held := rows.count()) > MOST_LABELLED:
        raise ValueError(f"{held} labelled urls; at most {MOST_LABELLED} train one expression")
    if not held:
        return [0.0] * (buckets + 1)
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("b", "y"))).alias("rows")).select(F.posexplode("rows").alias("r", "row")).select("r", "row.*")
    shares = rows.select("r", F.explode(F.transform("b", lambda b: F.struct(b.alias("b"), (1 / F.size("b")).alias("x")))).alias("f")).groupBy("r", "f.b").agg(F.sum("f.x").alias("x"))
    other = shares.select(F.col("r").alias("s"), "b", F.col("x").alias("z"))
    products = shares.join(other, "b").groupBy("r", "s").agg(F.sum(F.col("x") * F.col("z")).alias("k")).groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("s", "k"))).alias("k"))
    table = rows.select("r", "y").join(products, "r", "left").agg(F.sort_array(F.collect_list(F.struct("r", "y", F.transform(F.sequence(F.lit(0), F.lit(held - 1)), lambda s: F.coalesce(F.try_element_at("k", s), F.lit(0.0)) + OFFSET_SHARE).alias("k")))).alias("rows"))

    def step(factors: Column) -> Column:
        dot = lambda k: F.aggregate(F.zip_with(factors, k, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.zip_with(factors, "rows", lambda a, row: a + (rate / held) * (row["y"] - 1 / (1 + F.exp(-dot(row["k"])))))

    factors = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_repeat(F.lit(0.0), held), lambda a, _: step(a)).alias("a")).first()["a"]
    weights = [0.0] * buckets + [OFFSET_SHARE * sum(factors)]
    for w in shares.groupBy("b").agg(F.sum(F.col("x") * F.get(F.lit(factors), F.col("r"))).alias("w")).collect():
        weights[w["b"]] = w["w"]
    return weights


def labelled_urls(spark: SparkSession) -> DataFrame:
    """LABELLED as a table."""
    values = ", ".join(f"('{u}', {y})" for u, y in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, n: int = 3, buckets: int = 4096, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score (probability to block) of every row's url.

    The rule's verdict holds; else block from threshold on. Null urls have an empty host and path and are scored as
    such. Repeated rows give a row each; other columns aren't read. Work: one pass over url, without a shuffle.
    """
    weights = F.lit(train(labelled, n, buckets))
    host, path = split_url("url")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-_logit(weights, features(F.col("host"), F.col("path"), n, buckets))))
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), score.alias("score"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
