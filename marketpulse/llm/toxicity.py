"""Toxicity: a linear classifier of character n-grams, whose features are scaled by naive Bayes log-count ratios.

A feature is whether a text has an n-gram of ORDERS characters (lower case of every script, a blank before and after
the text), hashed to 2**BITS values. Document counts by class give each feature its log-count ratio; features whose
ratio is small, or no more than LEAST_ERRORS of its own standard error, are left out, the others are scaled by it and
weighted by logistic regression. A part of the sample is kept to fit the line that turns sums into probabilities.

The classifier is fitted on a bounded sample (`labelled.SAMPLE_ROWS` documents): counts and chosen features are made
by tasks; the driver gets at most 2**BITS counts and the sample's chosen features. Without both classes in the
sample every score is the share of toxic documents in it, or 0.

Nulls: a null text is empty and has the score of an empty text; a null id stays null and is not held out; labels that
are null or neither 0 nor 1 are not used. Repeated documents give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, labelled, pieces, words

ORDERS = (4, 6, 8)
BITS = 22
SMOOTHING = 1.0
LEAST_RATIO = 1.2
LEAST_ERRORS = 1.35
PENALTY = 30.0
STEPS = 80
RARE_WEIGHT = 2.0
THRESHOLD = 0.7
FOLDS, FOLD = 3, 1
#: Bytes of text whose n-grams are held at a time; there are three for each byte.
SLICE_BYTES = 256 << 10

_CALIBRATION = 4  # every fourth document of the sample


def grams(column: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a column of texts; of features with a true value in `chosen` only."""
    data, bounds = words.text_bytes(pc.utf8_lower(frames.strings(column)))
    points, at = pieces.code_points(data)
    if at is not None:
        bounds = np.searchsorted(at, bounds)
    data = words.mix(np.insert(points.astype(np.uint64), bounds, 32) + np.uint64(1))
    pads = bounds + np.arange(len(bounds))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(pads))
    last = pads[1:][owner]
    sums, pairs = data.copy(), []
    for n in range(2, max(ORDERS) + 1):
        sums = sums[: len(data) - n + 1] * words._BASE + data[n - 1 :]
        if n in ORDERS:
            feature = (words.mix(sums) >> np.uint64(64 - BITS)).astype(np.int64)
            inside = np.arange(len(feature)) + n - 1 <= last[: len(feature)]
            keep = np.flatnonzero(inside if chosen is None else inside & chosen[feature])
            pairs.append((owner[keep] << BITS) | feature[keep])
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that have a feature."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in frames.slices(batches, limit=SLICE_BYTES):
        label = batch.column("label").to_numpy(zero_copy_only=False)
        owner, feature = grams(batch.column("text"))
        for kind in (0, 1):
            np.add.at(counts[kind], feature[label[owner] == kind], np.int32(1))
    some = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(some), 1 << 16):
        part = some[k : k + (1 << 16)]
        columns = [pa.array(part), *(pa.array(c.astype(np.int64)) for c in counts[:, part])]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}  # those are made again in each task

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a feature is chosen, and the order of the chosen ones: a weight for each value would be 32 MB."""
        chosen = np.zeros(1 << BITS, bool)
        chosen[self.features] = True
        return chosen, np.argsort(self.features)

    def scores(self, column: pa.Array) -> np.ndarray:
        chosen, order = self.tables
        owner, feature = grams(column, chosen)
        weight = self.weights[order[np.searchsorted(self.features, feature, sorter=order)]]
        sums = np.bincount(owner, weight, minlength=len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def _logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, steps: int):
    """Weights and bias by full-batch steps, each sized by its own past gradients."""
    weights, bias = np.zeros(len(scale)), float(np.log(y.mean() / (1 - y.mean())))
    past, past_bias = np.full(len(scale), 1e-8), 1e-8
    for _ in range(steps):
        sums = np.bincount(rows, (weights * scale)[cols], minlength=len(y)) + bias
        error = 1 / (1 + np.exp(-np.clip(sums, -35, 35))) - y
        slope = np.bincount(cols, error[rows], minlength=len(scale)) * scale + penalty * weights
        past += slope**2
        weights -= 0.1 * slope / np.sqrt(past)
        past_bias += error.sum() ** 2
        bias -= 0.1 * error.sum() / np.sqrt(past_bias)
    return weights * scale, bias


def _line(sums: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit probabilities to sums.

    Targets are smoothed towards the classes' sizes; the rarer class counts more, by a power of how much rarer it is.
    """
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target = np.where(y == 1, high, low)
    weight = np.where(y == 1, ((len(y) - y.sum()) / y.sum()) ** RARE_WEIGHT, 1.0)

    def loss(a: float, b: float) -> float:
        x = a * sums + b
        return float((weight * (np.logaddexp(0, x) - target * x)).sum() + 5e-4 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * sums + b, -35, 35)))
        w = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * sums * sums).sum() + 1e-3, (w * sums).sum()], [(w * sums).sum(), w.sum() + 1e-6]])
        error = weight * (p - target)
        g = np.array([(error * sums).sum() + 1e-3 * (a - 1), error.sum()])
        step, now = np.linalg.solve(h, g), loss(a, b)
        for _ in range(40):  # a step that does not improve the fit is halved
            if loss(a - step[0], b - step[1]) <= now:
                break
            step = step / 2
        a, b = a - step[0], b - step[1]
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = FOLDS, fold: int = FOLD) -> Model:
    """Learn from a bounded sample of the labelled documents outside the held-out fold."""
    sample = frames.checkpointed(labelled.sample(docs, labels, label_col, folds, fold))
    size = sample.agg(F.count("*"), F.sum("label")).first()
    total, toxic = size[0], size[1] or 0
    if not 0 < toxic < total:
        share = min(max(toxic / total if total else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    clean = total - toxic
    per_toxic = F.col("clean") * (toxic / clean)
    ratio = F.log((F.col("toxic") + SMOOTHING) / (per_toxic + SMOOTHING))
    error = F.sqrt(1 / (F.col("toxic") + SMOOTHING) + 1 / (per_toxic + SMOOTHING))
    counted = (
        sample.select("text", "label")
        .mapInArrow(_counts, "feature long, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= 2)
        .select("feature", ratio.alias("ratio"), error.alias("error"))
        .where((F.abs("ratio") > LEAST_RATIO) & (F.abs("ratio") > LEAST_ERRORS * F.col("error")))
        .select("feature", "ratio")
        .orderBy("feature")
        .toPandas()
    )
    features, scale = counted["feature"].to_numpy(np.int64), counted["ratio"].to_numpy(float)

    def chosen_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(1 << BITS, bool)
        chosen[features] = True
        for batch in frames.slices(batches, limit=SLICE_BYTES):
            owner, feature = grams(batch.column("text"), chosen)
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found = np.searchsorted(features, feature).astype("<i4")
            lists = [found[at[k] : at[k + 1]].tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(lists, pa.binary()), batch.column("doc_id")], ["label", "found", "doc_id"])

    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(chosen_grams, f"label int, found binary, doc_id {kind}")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "found").toPandas()
    y = rows["label"].to_numpy(float)
    found = [np.frombuffer(x, "<i4") for x in rows["found"]]
    cols = np.concatenate(found).astype(np.int64)
    owner = np.repeat(np.arange(len(y)), [len(x) for x in found])

    def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = keep[owner]
        return np.cumsum(keep)[owner[own]] - 1, cols[own]

    apart = np.arange(len(y)) % _CALIBRATION == 0
    a, b = 1.0, 0.0
    if min(y[apart].sum(), (1 - y[apart]).sum(), y[~apart].sum(), (1 - y[~apart]).sum()) >= 5:
        weights, bias = _logistic(*part(~apart), scale, y[~apart], PENALTY, STEPS)
        own, own_cols = part(apart)
        a, b = _line(np.bincount(own, weights[own_cols], minlength=int(apart.sum())) + bias, y[apart])
    weights, bias = _logistic(owner, cols, scale, y, PENALTY, STEPS)
    return Model(features, a * weights, a * bias + b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, limit=SLICE_BYTES):
            scores = pa.array(model.scores(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    rows = frames.texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and prediction of each document, by a classifier that never saw the held-out fold."""
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        labelled.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not call toxic, with all their columns."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, text_col, SLICE_BYTES):
            yield batch.filter(pa.array(model.scores(batch.column(text_col)) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
