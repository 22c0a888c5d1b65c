"""Member lists and ledgers as they arrive: CSV files with a header, or Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.sources.extracts import read_text_crosstab
from marketpulse.sources.ledger import read_long, read_wide
from marketpulse.sources.members import read_members
from marketpulse.spec import SegmentSpec


def read_raw(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """All files as one table with clean column names; a column that a file lacks is null there."""
    if all(p.endswith(".parquet") for p in paths):
        return spark.read.option("mergeSchema", True).parquet(*paths)
    tables = read_text_crosstab(spark, paths, sep)
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class MemberFiles:
    """One segment's member list."""

    paths: tuple[str, ...]
    spec: SegmentSpec
    sep: str = ","

    def read(self, spark: SparkSession) -> DataFrame:
        return read_members(read_raw(spark, self.paths, self.sep), self.spec)


@dataclass(frozen=True)
class LedgerFiles:
    """Ledger files of one layout: ``long`` (a row per account) or ``wide`` (a column per account)."""

    paths: tuple[str, ...]
    layout: str
    specs: tuple[SegmentSpec, ...]
    period: str | None = None
    sep: str = ","

    def read(self, spark: SparkSession) -> DataFrame:
        raw = read_raw(spark, self.paths, self.sep)
        if self.layout == "long":
            return read_long(raw, self.specs, self.period or "ano")
        if self.layout == "wide":
            return read_wide(raw, self.specs, self.period or "ano_tri")
        raise ValueError(f"unknown ledger layout {self.layout!r}")


def money_text(cents: str) -> Column:
    """Cents as the ledger files write them: ``123456`` -> ``1234.56``."""
    return (F.col(cents).cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")
