import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketpulse.llm import labelled, quality, toxicity
from cases import no_documents, odd_documents, odd_rows

LARGE, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, text string"


def tables(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_held_out_fold_and_shape(spark, operator):
    rows = operator.report(*tables(spark, SMALL)).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % operator.FOLDS == operator.FOLD)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def rates(spark, operator, label):
    docs, labels = tables(spark, LARGE)
    found = operator.report(docs, labels).join(labels, "doc_id").where("held_out")
    table = found.groupBy(label).agg(F.avg("predicted").alias("rate")).collect()
    return {r[label]: r.rate for r in table}


def test_held_out_quality(spark):
    rate = rates(spark, quality, "quality")
    assert rate[1] > 0.98 and rate[0] < 0.05


def test_held_out_toxicity(spark):
    rate = rates(spark, toxicity, "toxic")
    assert rate[0] < 0.01 and rate[1] >= 0.9


def test_toxic_grams_are_characters():
    """Any script, capitals as small letters, and no gram that begins or ends within a character."""
    texts = ["идиот МУСОР 日本語テキスト", "ИДИОТ мусор 日本語テキスト", "éÉ" * 9]
    owner, feature = toxicity.grams(pa.array(texts))
    sets = [set(feature[owner == k].tolist()) for k in range(3)]
    assert sets[0] == sets[1]
    padded = f" {texts[0].lower()} "
    assert len(sets[0]) == len({padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)})
    assert len(sets[2]) == len({f" {'éé' * 9} "[i : i + n] for n in toxicity.ORDERS for i in range(20 - n + 1)})


def test_labels_of_the_held_out_fold_are_never_used(spark):
    docs, labels = tables(spark, SMALL)
    for operator, column in ((quality, "quality"), (toxicity, "toxic")):
        out = labelled.held_out(F.col("doc_id"), operator.FOLDS, operator.FOLD)
        turned = labels.withColumn(column, F.when(out, 1 - F.col(column)).otherwise(F.col(column)))
        assert sorted(operator.report(docs, labels).collect()) == sorted(operator.report(docs, turned).collect())


def test_sample_is_bounded(spark):
    docs, labels = tables(spark, SMALL)
    assert labelled.sample(docs, labels, "toxic", 3, 1, rows=50).count() == 50


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_documents(spark, operator):
    docs, labels = odd_documents(spark), spark.createDataFrame(
        [(1, 1, 0, "x"), (2, 0, 1, None), (3, 0, 1, None), (6, 1, None, None), (None, 1, 1, "x"), (7, 5, -3, "x"), (1, 1, 0, "x")],
        LABELS,
    )
    rows = operator.report(docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3)}
    assert len(empty) == 1
    assert operator.report(no_documents(spark), labels).count() == 0
    unlabelled = operator.report(docs, labels.limit(0)).collect()
    assert len({r.score for r in unlabelled}) == 1
    one_class = operator.report(docs, labels.where("doc_id = 1")).collect()
    assert len({r.score for r in one_class}) == 1


def test_rejection_keeps_columns_and_clean_documents(spark):
    docs, labels = tables(spark, SMALL)
    kept = toxicity.reject(docs, labels)
    predicted = {r.doc_id: r.predicted for r in toxicity.report(docs, labels).collect()}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in predicted.items() if not p}


def test_grams_are_those_of_each_text():
    texts = ["Abc def", "", "abc", "abcdé"]
    owner, feature = toxicity.grams(pa.array(texts))
    for k, text in enumerate(texts):
        alone, own = toxicity.grams(pa.array([text]))
        assert sorted(feature[owner == k]) == sorted(own)
        raw = f" {text.lower()} "  # n-grams of characters, not of bytes
        distinct = {raw[i : i + n] for n in toxicity.ORDERS for i in range(len(raw) - n + 1)}
        assert len(own) == len(distinct)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
