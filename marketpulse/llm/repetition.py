"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes of the words (numpy, over many texts at a time) mark the n-grams that a text
has twice or more; the rule measures the share of its word characters inside repetitions (the first place of an
n-gram is none), and the share of its characters in lines that repeat an earlier one. A text that exceeds any limit is not kept.

Nulls: a null text has no words. A text without words has coverage 0 and fails the base rule (fewer than 20 words).
Repeated documents give a row each; a null id is kept. Memory follows `SLICE_BYTES` or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketpulse.llm import frames, words

#: Most share of word characters inside repeated n-grams, by n. Fixed values of the published repetition rules.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
BASE_GRAM = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "dup_line_share": "double",
    **{f"dup_{n}gram_share": "double" for n in GRAM_LIMITS},
}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of each text."""
    found = words.split(column, words.NOT_SPACE, lower=False)
    data, bounds, doc = found.data, found.bounds, found.doc
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    hashes = words.span_hashes(data, found.start, found.end)
    word_chars = chars[found.end] - chars[found.start]
    total = words.per_text(word_chars, found.first)

    out = {"n_words": found.counts, "word_chars": total, "n_symbols": words.per_text(_SYMBOL[data], bounds)}
    shares = {}
    at = np.arange(len(doc))  # only where a shorter n-gram is repeated can a longer one be
    for n in sorted({*GRAM_LIMITS, BASE_GRAM}):
        at = at[at + n <= len(doc)]
        at = at[doc[at] == doc[at + n - 1]]
        twice, later = words.repeated(doc[at], words.gram_hashes(hashes, n)[at])
        if n == BASE_GRAM:
            hit = words.covered(len(doc), at[twice], at[twice] + n)
            out["n_repeat_words"] = words.per_text(hit, found.first)
        if n in GRAM_LIMITS:
            again = words.covered(len(doc), at[later], at[later] + n)
            shares[f"dup_{n}gram_share"] = _share(words.per_text(np.where(again, word_chars, 0), found.first), total)
        at = at[twice]

    start, end, first = words.runs(data != 10, bounds)  # an empty line has no word
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.NOT_SPACE[data], out=sums[1:])
    filled = sums[end] > sums[start]
    line_doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))[filled]
    start, end = start[filled], end[filled]
    _, later = words.repeated(line_doc, words.span_hashes(data, start, end))
    size, texts = chars[end] - chars[start], len(bounds) - 1
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=texts)
    in_lines = np.bincount(line_doc, size, minlength=texts)
    shares["dup_line_share"] = _share(np.bincount(line_doc[later], size[later], minlength=texts), in_lines)

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]
    )
    over = shares["dup_line_share"] > LINE_LIMIT
    for n, limit in GRAM_LIMITS.items():
        over |= shares[f"dup_{n}gram_share"] > limit
    return out | {"kept": ~out["base_failed"] & ~over} | shares


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    for batch in frames.slices(batches):
        found = measure(batch.column("text"))
        columns = [pa.array(found[name], kinds[kind]) for name, kind in _COLUMNS.items()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_COLUMNS])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base measures, the base verdict, repetition coverage, and whether it is kept."""
    rows = frames.texts(docs, id_col, text_col)
    schema = ", ".join(f"{name} {kind}" for name, kind in _COLUMNS.items())
    return rows.mapInArrow(_run, f"doc_id {dict(rows.dtypes)['doc_id']}, {schema}")
