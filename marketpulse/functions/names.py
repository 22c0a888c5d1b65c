"""Header cleaning, applied to column names when a file's schema is read."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame


def snake(name: str) -> str:
    """``Cód. ANS`` -> ``cod_ans``."""
    text = name.replace("%", " percent ").replace("#", " number ")
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def snake_all(names: Sequence[str]) -> list[str]:
    """Clean names, numbered from the second one on where two collide."""
    seen: Counter[str] = Counter()
    out = []
    for name in map(snake, names):
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_all(df.columns))
