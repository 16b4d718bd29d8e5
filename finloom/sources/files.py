"""Sources and sinks: rule tables, documents, statements and registers in files, as DataFrames of known columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rule_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, where lines that start with # are remarks; blanks round values go, empty ones are null."""
    read = spark.read.schema(schema).option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return read.csv(path)


def blocked_pairs(spark: SparkSession, path: str) -> DataFrame:
    """a and b of a blocklist, each pair once in either direction."""
    rows = rule_table(spark, path, "a string, b string").where("a IS NOT NULL AND b IS NOT NULL")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sector_map(spark: SparkSession, path: str, overrides: str | None = None) -> DataFrame:
    """code and sector; an override of a code goes first."""
    rows = rule_table(spark, path, "code string, sector string").withColumn("_p", F.lit(1))
    if overrides:
        rows = rows.union(rule_table(spark, overrides, "code string, sector string").withColumn("_p", F.lit(0)))
    return rows.where("code IS NOT NULL").groupBy("code").agg(F.min_by("sector", "_p").alias("sector"))


def panels(spark: SparkSession, path: str, year: str) -> DataFrame:
    """A row for each firm and year of JSON documents {"panels": [{"corp_code", "corp_name", "industry_code", "years": [...]}]}.

    year: the fields of a year, such as "year: int, revenue: double".
    """
    firm = f"corp_code: string, corp_name: string, industry_code: string, years: array<struct<{year}>>"
    docs = spark.read.schema(f"panels array<struct<{firm}>>").option("multiLine", True).json(path)
    return docs.select(F.inline("panels")).select("corp_code", "corp_name", "industry_code", F.inline("years"))


def code_list(spark: SparkSession, path: str, row: str = "list") -> DataFrame:
    """corp_code, corp_name and stock_code of an XML register, of firms with a stock code."""
    rows = spark.read.format("xml").option("rowTag", row).schema("corp_code string, corp_name string, stock_code string").load(path)
    return rows.withColumn("stock_code", F.trim("stock_code")).where(F.length("stock_code") > 0)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files: as UTF-8, or as Korean Windows text where that isn't valid."""

    @F.pandas_udf("string")
    def korean(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: b.decode("cp949", "replace"), na_action="ignore")

    text = F.col("content").cast("string")
    odd = F.when(F.is_valid_utf8(text), None).otherwise(F.col("content"))  # Python sees those files alone
    return spark.read.format("binaryFile").load(path).select("path", F.when(F.is_valid_utf8(text), text).otherwise(korean(odd)).alias("text"))


def date_windows(first: Column, last: Column, days: int) -> Column:
    """The spans [start, end] of at most days that cover first to last, both included, as an array."""
    starts = F.sequence(first, last, F.expr(f"INTERVAL {days} DAYS"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days - 1), last).alias("end")))


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes df by partition, replacing those partitions that df has and no others: a load can be run again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a line for each row."""
    df.write.mode("overwrite").json(path)


def audit_rows(df: DataFrame, column: str, schema: str = "array<string>") -> DataFrame:
    """df with a JSON column parsed; what isn't JSON counts as a list of itself, and rows with nothing go."""
    parsed = F.coalesce(F.from_json(column, schema), F.when(F.length(F.trim(F.col(column))) > 0, F.array(F.col(column))))
    kept = F.filter(parsed, lambda x: F.length(F.trim(x)) > 0)
    return df.withColumn(column, kept).where(F.size(column) > 0)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], StructType.fromDDL(schema))
