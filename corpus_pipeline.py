"""Five stages from raw documents to packed training sequences; belongs to ``millrace.llm``.

Every stage works on all rows its predecessor kept. The first four return the columns of
``documents``; the last returns the pieces of documents in each sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language, mixing, packing, quality, simhash
from millrace.plans.staging import stage

# The share of a text's letters that must lie in words that some known language may write.
LEAST_KNOWN_SHARE = 0.1
# Text whose distinct words are tokenised together, less than packing alone takes, and pieces of words kept
# for the next task, none: executors and their workers still hold what the stages before took.
SHARED_BYTES = 8 << 20
KNOWN_PIECES = 0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled classifier accepts."""
    return quality.kept(docs, "text", quality.fit(docs, "text", F.col("doc_id")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in the script of a known language, also those in several languages."""
    model = language.train(docs, "text", "lang", F.col("doc_id"))
    return language.kept(docs, "text", model, LEAST_KNOWN_SHARE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.representatives(docs, "doc_id", "text", shingle_words=3, max_bits=2)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mixture takes them: whole, in part, or more than once."""
    return mixing.Mix(docs, "doc_id", "text", "source").texts().withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    pieces = packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), shared_bytes=SHARED_BYTES, known_pieces=KNOWN_PIECES)
    return packing.with_checksums(pieces, keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_duplicates),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed),
]

# Hashes, trained models and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        result = function(spark, docs, sf_dir)
        docs = result if number == len(STAGES) - 1 else stage(result, f"pipeline-{number}")
    return docs
