"""Shares of scores."""

from pyspark.sql import functions as F

from finloom.functions.numbers import rounded
from finloom.operators.financials import blended


def test_the_rest_of_a_share(spark):
    """47.5 * 0.3 is 14.25, in the middle; 1 - 0.7 is a little more than 0.3."""
    lit = lambda v: F.lit(v).cast("double")
    got = spark.range(1).select(rounded(blended(lit(0), lit(47.5)), 1), blended(lit(None), lit(5)), blended(lit(5), lit(None))).first()
    assert tuple(got) == (14.2, 5.0, 5.0)
