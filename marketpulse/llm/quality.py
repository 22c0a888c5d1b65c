"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is put into bins; boosting goes round the features, again and again, and fits a shallow tree
to one of them at a time, whose leaves add up to a lookup table per feature. Then the pairs of features that explain
most of what is left get tables of two dimensions, by trees that cut both. A score is the sum of the looked-up
values, made for many texts at once.

It is fitted on the features of a bounded sample (`labelled.SAMPLE_ROWS` documents); only these numbers go to the
driver. Without both classes in the sample every score is the share of good documents in it, or 0.5 without labels.

Nulls: a null text is empty, and an empty text has features 0; a null id stays null and is not held out; labels that
are null or neither 0 nor 1 are not used. Repeated documents give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, labelled, words

FOLDS, FOLD = 4, 2
THRESHOLD = 0.7
BINS = 24
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 80
PAIR_ROUNDS = 30
RATE = 0.15
LEAST_LEAF = 5


def _bytes(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SMALL, _BIG = _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = {
    "capitals": _BIG,
    "digits": _bytes("0123456789"),
    "symbols": _bytes("#*$%&@^~_=+<>{}[]\\/"),
    "bars": _bytes("|"),
    "marks": _bytes("!?"),
    "stops": _bytes(".,;:"),
    "lines": _bytes("\n"),
}
_NOT_LETTER = ~(_SMALL | _BIG)
_NOT_LETTER[128:] = False
FEATURES = (
    "size",
    "word_length",
    "long_words",
    "short_words",
    "odd_starts",
    "odd_ends",
    "odd_words",
    "capital_words",
    "distinct_words",
    "repeated_grams",
    "repeated_lines",
    *_CLASSES,
)


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    found = words.split(column, words.NOT_SPACE, lower=False)
    data, doc, n = found.data, found.doc, np.maximum(found.counts, 1)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    length = chars[found.end] - chars[found.start]
    total = np.maximum(chars[found.bounds[1:]] - chars[found.bounds[:-1]], 1)
    first, last = data[found.start], data[found.end - 1]

    def share(flags: np.ndarray) -> np.ndarray:
        return words.per_text(flags, found.first) / n

    hashes = words.span_hashes(data, found.start, found.end)
    _, again = words.repeated(doc, hashes)
    inside = np.flatnonzero(words.gram_inside(doc, 5))
    twice, _ = words.repeated(doc[inside], words.gram_hashes(hashes, 5)[inside])
    start, end, line_first = words.runs(data != 10, found.bounds)
    line_doc = np.repeat(np.arange(len(total)), np.diff(line_first))
    _, line_again = words.repeated(line_doc, words.span_hashes(data, start, end))
    out = [
        np.log1p(found.counts),
        words.per_text(length, found.first) / n,
        share(length > 12),
        share(length <= 3),
        share(_NOT_LETTER[first]),
        share(_NOT_LETTER[last] & ~_CLASSES["stops"][last]),
        share((length == 1) & _NOT_LETTER[first]),
        share(_BIG[first] & (_BIG[data[np.minimum(found.start + 1, found.end - 1)]]) & (length > 1)),
        1 - share(again),
        share(words.covered(len(doc), inside[twice], inside[twice] + 5)),
        words.per_text(line_again, line_first) / np.maximum(np.diff(line_first), 1),
    ]
    out += [words.per_text(kind[data], found.bounds) / total for kind in _CLASSES.values()]
    return np.stack(out, axis=1).astype(float)


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        sums = np.full(len(x), self.bias)
        if self.tables:
            at = self.bins(x)
            for k, table in enumerate(self.tables):
                sums += table[at[:, k]]
            for a, b, table in self.pairs:
                sums += table[coarse(at[:, a]), coarse(at[:, b])]
        return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def coarse(at: np.ndarray) -> np.ndarray:
    return at * PAIR_BINS // (BINS + 1)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best place to cut a row of bins in two, and the gain."""
    g1, h1, n1 = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    g2, h2, n2 = g.sum() - g1, h.sum() - h1, n.sum() - n1
    gain = g1**2 / (h1 + 1) + g2**2 / (h2 + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((n1 >= LEAST_LEAF) & (n2 >= LEAST_LEAF), gain, -1.0)
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-RATE * g.sum() / (h.sum() + 1))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of two levels."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        cut = []
        for a, b in parts:
            gain, at = _cut(g[a:b], h[a:b], n[a:b]) if b - a > 1 else (-1.0, 0)
            cut += [(a, a + at), (a + at, b)] if gain > 0 else [(a, b)]
        parts = cut
    for a, b in parts:
        out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature and then, on either side, the other: its gain and its values."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gs, hs, ns = (m.T if turned else m for m in (g, h, n))
        for at in range(1, len(gs)):
            gain, values = 0.0, np.zeros_like(gs)
            for side in (slice(0, at), slice(at, len(gs))):
                g1, h1, n1 = gs[side].sum(axis=0), hs[side].sum(axis=0), ns[side].sum(axis=0)
                more, where = _cut(g1, h1, n1)
                ends = [slice(0, where), slice(where, len(g1))] if more > 0 else [slice(0, len(g1))]
                for end in ends:
                    gain += g1[end].sum() ** 2 / (h1[end].sum() + 1)
                    values[side, end] = _leaf(g1[end], h1[end])
            if gain > best:
                best, out = gain, values.T if turned else values
    return best, out


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables: first of single features, by turns, then of the chosen pairs."""
    model = Model(float(np.log(y.mean() / (1 - y.mean()))))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], cuts)) for k in range(x.shape[1])]
    # a value that most texts share takes most quantiles; the rest get cuts of their own
    for k, edges in enumerate(model.edges):
        apart = x[:, k][x[:, k] > np.median(x[:, k])]
        if len(edges) < BINS // 2 and len(apart):
            more = np.unique(np.quantile(apart, np.linspace(0, 1, BINS - len(edges))))
            model.edges[k] = np.unique(np.concatenate([edges, more]))[: BINS - 1]
    model.tables = [np.zeros(BINS + 1) for _ in model.edges]
    at, sums = model.bins(x), np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            size = BINS + 1
            tree = _tree(*(np.bincount(at[:, k], w, minlength=size) for w in (g, h)), np.bincount(at[:, k], minlength=size))
            table += tree
            sums += tree[at[:, k]]
    rough = coarse(at)

    def grid(a: int, b: int, weights: np.ndarray | None) -> np.ndarray:
        cell = rough[:, a] * PAIR_BINS + rough[:, b]
        return np.bincount(cell, weights, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS).astype(float)

    def fit_pair(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        return _pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, None))

    count = x.shape[1]
    gains = sorted(((fit_pair(a, b)[0], a, b) for a in range(count) for b in range(a + 1, count)), reverse=True)
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            _, tree = fit_pair(a, b)
            table += tree
            sums += tree[rough[:, a], rough[:, b]]
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames.slices(batches):
        rows = pa.array(features(batch.column("text")).tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS, fold: int = FOLD) -> Model:
    """Learn from a bounded sample of the labelled documents outside the held-out fold."""
    sample = labelled.sample(docs, labels, label_col, folds, fold)
    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(_measure, f"doc_id {kind}, label int, x array<double>").toPandas()
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))))
    x = np.stack(rows["x"].tolist())
    order = np.lexsort((*x.T, y))  # the sums of boosting do not depend on the order of the sample's rows
    return boost(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches):
            scores = pa.array(model.scores(features(batch.column("text"))), pa.float64())
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
