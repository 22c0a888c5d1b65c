"""Member lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.names import clean_names
from marketpulse.spec import SegmentSpec


def read_members(raw: DataFrame, spec: SegmentSpec) -> DataFrame:
    """A raw list with its own headers -> segmento, registro, associada and the other columns."""
    df = clean_names(raw)
    registro = F.col(spec.member_id).cast("string")
    others = [c for c in df.columns if c not in (spec.member_id, "registro", "associada")]
    return df.select(
        F.lit(spec.segmento).alias("segmento"),
        registro.alias("registro"),
        F.lit(1).alias("associada"),
        *others,
    )
