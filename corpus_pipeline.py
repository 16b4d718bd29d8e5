"""A training corpus from raw documents: language, near duplicates, benchmark passages, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.decontaminate import benchmark_hits
from finloom.llm.langid import UNKNOWN, held_out, identify
from finloom.llm.mixing import mix_sources, mixed_documents
from finloom.llm.ngram_join import link_near_duplicates
from finloom.llm.queries import token_file_digest
from finloom.llm.storage import dropped, small_batches, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of no language: null texts and texts without a letter."""
    small_batches(spark)
    found = identify(docs, docs.where(~held_out("doc_id", 3, 1)), carry=True)
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the smallest doc_id, null last; of several texts
    under that id one, and any of the rows that repeat it. Texts without words link with nothing and stay.

    Rows are told apart by a 64-bit hash of id and text, so neither null nor repeated ids matter.
    """
    small_batches(spark)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text", F.struct("*").alias("row"))
    linked = link_near_duplicates(keyed.select(F.col("k").alias("doc_id"), "text")).where("n_shingles > 0")
    rows = linked.groupBy(F.col("doc_id").alias("k")).agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    ids = keyed.groupBy("k").agg(F.min("doc_id").alias("id"))
    rows = written(rows.join(ids, "k"), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k")).alias("f")).select("f.k", F.lit(True).alias("stays"))
    verdicts = written(rows.join(first, "k", "left").where("stays IS NULL OR n > 1").select("k", F.col("stays").isNotNull().alias("once")), "verdicts")
    dropped(rows)
    once = verdicts.where("once").select("k")
    left = keyed.join(verdicts.select("k"), "k", "left_anti")
    if not once.isEmpty():
        left = left.unionByName(keyed.join(once, "k", "left_semi").dropDuplicates(["doc_id", "text"]))
    return left.select("row.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_hits(docs, benchmark, carry=True).where("n_hit = 0").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs mixed to the sources' targets: of each document a row for each round that takes words of it, with these."""
    small_batches(spark)
    return mixed_documents(docs, mix_sources(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of docs, read back from the token files written of them. Workers
    remember few words: at the end of the pipeline executors have little memory left."""
    small_batches(spark)
    return token_file_digest(docs, 100_000)


STAGES = [("language id", languages), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_passages), ("mixing sources", mixture), ("token files", token_ids)]

#: Suffix automata, permutations and tokenizers have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
