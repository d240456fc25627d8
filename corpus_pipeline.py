"""Cleaning a corpus in five stages, from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of docs.  ORACLE_SQL is None: rank-order profiles, XXH64
fingerprints and BPE ids have no SQL form; tests/llm compares the stages with plain
versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.ship import ship
from assay.llm import language_id, line_dedup, packing, secrets, simhash
from assay.llm.common import materialize

#: A document stays if the nearest profile is at least this near; real prose is far above, other scripts and noise near zero.
MIN_LANGUAGE_SCORE = 0.1


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, n_chars as the text now is."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; no letters, or none of the profiles near: out."""
    ship(spark)
    profiles = language_id.build_profiles(docs)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    if {"lang_pred", "score"} & set(docs.columns):  # the operator would replace them
        held = docs.select(F.struct(*docs.columns).alias("_row"), "text")
        return language_id.identify(held, profiles).where(known).select("_row.*")
    return language_id.identify(docs, profiles).where(known).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier passages; a document of which nothing is left goes."""
    ship(spark)
    held = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    done = line_dedup.dedup(held).where("n_lines = 0 OR n_removed < n_lines")
    return _counted(done.select("_row.*", F.col("text").alias("_text")).withColumn("text", F.col("_text")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    ship(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    ship(spark)
    return _counted(secrets.redacted(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
