"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from marketpulse.llm import (
    bpe,
    decontaminate,
    htmltext,
    jaccard,
    licenses,
    matrixbpe,
    quality,
    repetition,
    secrets_scan,
    tokenfiles,
    toxicity,
    variants,
    whitening,
)
from marketpulse.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _over(operator: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, name) for name in names))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": _over(htmltext.extract, "pages"),
    "op2_secret_scan": _over(secrets_scan.report, "documents"),
    "op3_quality_classifier": _over(quality.report, "documents", "labels"),
    "op4_decontamination": _over(decontaminate.report, "documents", "benchmark"),
    "op5_repetition_rules": _over(repetition.report, "documents"),
    "op6_bpe": _over(bpe.report, "documents"),
    "op7_license_scan": _over(licenses.report, "documents"),
    "op8_jaccard_join": _over(jaccard.join, "documents"),
    "op9_token_files": _over(tokenfiles.report, "documents"),
    "op10_toxicity": _over(toxicity.report, "documents", "labels"),
    "op11_spelling_variants": _over(variants.variants, "documents"),
    "op12_matrix_bpe": _over(matrixbpe.report, "documents"),
    "op13_whitening": _over(whitening.report, "embeddings"),
    "pipeline": corpus_pipeline.run,
}
