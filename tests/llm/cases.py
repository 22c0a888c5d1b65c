"""Documents that every operator must take: nulls, empty and very long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Names that operators use inside; a table may have such columns of its own.
CLASHING = {"score": "double", "key": "string", "row": "long", "found": "string", "ids": "string", "label": "int", "n": "int"}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + "".join(
    f", {name} {kind}" for name, kind in CLASHING.items()
)


def lower(text: str | None) -> str:
    """A-Z in lower case, other characters as they are."""
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def long_text(words: int = 30_000) -> str:
    rng = random.Random(3)
    return " ".join(rng.choice("alpha beta gamma delta épsilon zeta eta".split()) for _ in range(words))


def odd_rows() -> list[tuple]:
    texts = [
        (1, "Alpha beta gamma delta alpha beta gamma delta.\nAlpha beta gamma delta alpha beta gamma delta."),
        (2, ""),
        (3, None),
        (None, "no id here"),
        (4, " \n\t \x0b"),
        (5, long_text()),
        (6, "same text twice, with 'quotes', 日本語 and \U0001f642 café x"),
        (6, "same text twice, with 'quotes', 日本語 and \U0001f642 café x"),
        (7, "same text twice, with 'quotes', 日本語 and \U0001f642 café x"),
        (None, None),
    ]
    extra = (0.5, "k", 9, "f", "i", 7, 3)
    rows = [(i, t, "en", f"s{k}", len(t or ""), *extra) for k, (i, t) in enumerate(texts)]
    rows.append((8, "all other columns are null", None, None, None, *[None] * len(extra)))
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id_and_text(docs) -> list[tuple]:
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
