"""A document pipeline of five of the corpus operators, each stage on what the last one kept.

run(spark, sf_dir) applies STAGES to the documents table. A stage takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, ngramjoin, packing, secrets, substring
from tessera.llm.common import materialize

#: A document is kept with at least this share of its word marginals on one language.
LEAST_LANGUAGE_SHARE = 0.5


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with n_chars following the text, where ``like`` has that column."""
    if "n_chars" not in like.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no language explains for half the words.

    The labeller learns from documents whose crc32(doc_id as text) mod 3 is not 1. Null texts
    go; rows that repeat stay; an empty table gives none; extra columns of any name stay.
    """
    model = language.train_language(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return language.explained_rows(docs, model, LEAST_LANGUAGE_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8 Jaccard or more.

    Null and empty texts are linked with nothing and stay; rows equal in doc_id and text are
    one; an empty table gives none; all columns stay.
    """
    return ngramjoin.keep_first_of_each(docs, k=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of fifty words or more that an earlier document has; n_chars follows the text.

    Documents left without text go, also those that had none; shorter texts and repeated rows
    of one doc_id stay as they are; an empty table gives none; all columns stay.
    """
    return _with_length(substring.remove_repeats(docs, window=50), docs).where("text IS NOT NULL AND trim(text) <> ''")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks owner-specific, live-looking credentials; n_chars follows the text.

    Rows stay, also null texts and repeated rows; an empty table gives none; all columns stay.
    """
    return _with_length(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the kept documents into windows of 2048 tokens, one row per piece.

    A null or empty text is its end id; repeated rows are packed each; an empty table gives none.
    """
    return packing.pack_documents(docs, window=2_048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secret_scan", hide_secrets),
    ("packing", pack),
]

#: The language labeller is a learned model, so SQL cannot give the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
