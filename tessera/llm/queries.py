"""One thin query per corpus operator: whole table in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, media, ngramjoin, oracles, packing, quality, sampling, secrets, substring, tokenfile, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 3: rows with remainder 1 are held out of learning."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), remainder() != 1)
    return quality.score_quality(docs, model).withColumn("held_out", remainder() == 1).select("doc_id", "held_out", "score", "predicted")


def op2_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_segmentations(table(spark, sf_dir, "documents"), k=2, seed=0, with_ids=False)


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train_language(docs, remainder() != 1)
    found = language.predict_language(docs.select("doc_id", "text"), model)
    return found.withColumn("held_out", remainder() == 1).select("doc_id", "held_out", "lang_pred", "score")


def op4_suffix_tree_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.removed_words(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), window=2_048, end_id=1)


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op8_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op9_block_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized("embedding", 1_024.0).alias("q"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op10_token_dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write_tokens(table(spark, sf_dir, "documents"), end_id=2)
    return tokenfile.read_tokens(spark, folder, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bradley_terry_quality": op1_bradley_terry_quality,
    "op2_gumbel_segmentations": op2_gumbel_segmentations,
    "op3_crf_language": op3_crf_language,
    "op4_suffix_tree_substrings": op4_suffix_tree_substrings,
    "op5_trie_jaccard": op5_trie_jaccard,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op7_secret_ownership": op7_secret_ownership,
    "op8_iso_media": op8_iso_media,
    "op9_block_pruned_topk": op9_block_pruned_topk,
    "op10_token_dictionary_files": op10_token_dictionary_files,
}

#: The others hold a learned model, a codec's bytes or a packing, which SQL cannot state.
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
