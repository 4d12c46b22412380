"""Five corpus stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, jaccard, langid, substr, tokens
from tidemark.llm.queries import held_out
from tidemark.llm.runtime import ensure_checkpoint_dir, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (no text, no letter) go."""
    ensure_checkpoint_dir(spark)
    docs = docs.select(COLUMNS)
    return langid.keep_known(docs, langid.fit(docs.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingle sets with a Jaccard of 0.8 or more, the least id stays."""
    docs = docs.select(COLUMNS)
    linked = jaccard.link(docs, k=5, num=80, den=100)
    gone = linked.where("component_id <> doc_id").select(F.col("doc_id").alias("id"))
    return substr.without(docs, gone, "doc_id").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier too lose their words; texts left without any go."""
    done = substr.remove_repeats(docs, width=20, carry=("lang", "source"), keep_whole=True)
    done = done.where("n_removed < n_words or n_words = 0")
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match a benchmark item go."""
    docs = docs.select(COLUMNS)
    return decontam.Screen(docs, read(spark, sf_dir, "benchmark")).clean(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return tokens.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Trigram filters, components and latent retrieval can't be said in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; intermediate tables go to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
