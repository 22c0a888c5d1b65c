"""Bounded training samples: which labelled documents a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames

#: Most labelled documents that a classifier is fitted on.
SAMPLE_ROWS = 12_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo the number of folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    folds: int,
    fold: int,
    rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """At most about `rows` labelled documents outside the held-out fold: doc_id, text, label (0 or 1).

    Ids are taken in the order of their hash. The list of ids has at most `rows` entries, so it is broadcast and
    no text is shuffled. A document or label row that occurs twice counts twice.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return frames.texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
