"""A training corpus from raw documents: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again for the next one.
All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.llm import bpe, decontaminate, frames, jaccard, secrets_scan, toxicity

#: Near copies are documents whose sets of shingles of so many words have a Jaccard index of at least so many percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard.one_of_each(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; a document that is nothing else goes."""
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked; widely copied examples stay."""
    return secrets_scan.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, which decode to the text."""
    encoded = bpe.encode(docs, keep=["text", "lang", "source", "n_chars"])
    return encoded.select(
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scans", redact_secrets),
    ("bpe_encoding", encode_tokens),
]

#: A trained classifier, near copies and tokens: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what is between them lies in the cluster's shared folder."""
    folder = frames.shared_folder(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
