"""Places and percentiles by buckets against windows and the built-in percentile."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finloom.operators import ranks as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    pick = lambda: rng.choice([None, 0.0, -0.0, 1.0, 1.0, float("nan"), float("inf"), -float("inf"), 5e-324, 1e308, rng.uniform(-2, 2), rng.gauss(0, 1e6), rng.uniform(1, 1.0001), float(rng.randrange(5))])
    data = [(i, rng.choice(["a", "a", "a", "b", None]), pick(), f"t{i:04d}") for i in range(3000)]
    return spark.createDataFrame([*data, (5000, "one", 2.0, "x"), (5001, "null", None, "y")], "i int, g string, v double, s string").repartition(4)


def test_buckets_never_fall(rows):
    held = [r["b"] for r in rows.where("v IS NOT NULL").select("v", R.bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert held == sorted(held) and len(set(held)) > 100


@pytest.mark.parametrize("tie", ["i", "s"])
@pytest.mark.parametrize("down", [True, False])
def test_places(rows, tie, down):
    by = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last(), tie)
    want = rows.withColumn("p", F.row_number().over(by))
    got = R.numbered(rows, "g", "v", tie, "p", down)
    assert got.columns == want.columns and sorted((r["i"], r["p"]) for r in got.collect()) == sorted((r["i"], r["p"]) for r in want.collect())
    assert R.numbered(rows.where("false"), "g", "v", tie, "p").collect() == []


def test_percentiles(rows):
    finite = rows.where("v IS NULL OR (NOT isnan(v) AND abs(v) < 1e300)").withColumn("h", F.coalesce("g", F.lit("-")))
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    want = {r["h"]: (r["n"], r["p"]) for r in finite.groupBy("h").agg(F.count("v").alias("n"), F.percentile("v", F.lit([*at])).alias("p")).where("n > 0").collect()}
    got = {r["h"]: (r["n"], r["profile"]) for r in R.percentiles(finite, ["h"], "v", at).collect()}
    assert got.keys() == want.keys() and all(g[0] == want[k][0] and g[1] == pytest.approx(want[k][1], rel=1e-12, abs=1e-12) for k, g in got.items())
