"""The queries op1_ to op13_: each operator over its whole table, with the parameters of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .decontaminate import benchmark_hits
from .fingerprints import fingerprint_neighbours
from .langid import held_out, identify
from .lattice_lm import score_texts
from .mixing import mix_sources, taken_words
from .ngram_join import link_near_duplicates
from .oracles import ORACLES
from .pivot_join import link_vectors
from .storage import shared_folder, small_batches, written
from .substrings import remove_repeats
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .urls import judge_urls, labelled_urls
from .vector_codes import compress_vectors

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix_sources(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out("doc_id", 3, 1))
    found = identify(docs, labelled)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), labelled_urls(spark)).drop("score")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_neighbours(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"))


def token_file_digest(docs: DataFrame, remembered: int = 150_000) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, public_tokenizers.path(VOCABULARY), folder, remembered=remembered)
    return read_token_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), held_out("doc_id", 7, 2))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compress_vectors(table(spark, sf_dir, "embeddings"), ["label"])
    coded = written(codes.vectors, "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("l")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_url_filter, op4_fingerprints, op5_ngram_jaccard_join, op6_token_files, op7_lm_scores, op8_decontaminate, op9_token_counts, op10_substring_dedup, op11_embedding_dedup, op12_vector_codes, op13_align_tokenizers)}

__all__ = ["ORACLES", "QUERIES"]
