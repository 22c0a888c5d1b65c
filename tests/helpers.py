"""Inputs made of small frames, and readers of results."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import duckdb
from pyspark.sql import functions as F

from marketpulse.schema import ENROLMENT, LEDGER, MEMBERS
from marketpulse.sources.inputs import DIMENSIONS, known_quarters
from marketpulse.spec import MED, ODO

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")
Q = {n: date(2000 + n // 10, (n % 10) * 3 - 2, 1) for n in (153, 154, 161, 162, 163, 164, 211, 212, 221, 222)}

# The published parameters, with units small enough for hand-made figures.
MED1 = replace(MED, lives_unit=1.0, money_unit=1e9)
ODO1 = replace(ODO, lives_unit=1.0, money_unit=1e9)


class FrameInputs:
    """The inputs' interface over frames given by a test."""

    def __init__(self, spark, enrolment=(), members=(), ledger=()):
        self.spark = spark
        self._enrolment = spark.createDataFrame(list(enrolment), ENROLMENT)
        self._members = spark.createDataFrame([(s, r, 1) for s, r in members], MEMBERS)
        self._ledger = spark.createDataFrame(list(ledger), LEDGER)

    def enrolment(self, specs, dims, quarters):
        names = [s.segmento for s in specs]
        return self._enrolment.filter(
            F.col("segmento").isin(names) & F.col("competencia").isin(sorted(quarters))
        ).select(
            "segmento", "competencia", *[d for d in DIMENSIONS if d in dims], "beneficiarios"
        )

    def held(self, specs, dims, quarters, anchored=False):
        fact = self.enrolment(specs, dims, quarters)
        sets = fact.groupBy("segmento").agg(F.collect_set("competencia").alias("held"))
        return known_quarters(sets, specs, anchored)

    def serves(self, specs, dims, quarters):
        return True

    def members(self, specs):
        return self._members.filter(F.col("segmento").isin([s.segmento for s in specs]))

    def ledger(self, specs, years=None):
        df = self._ledger.filter(F.col("segmento").isin([s.segmento for s in specs]))
        return df if years is None else df.filter(F.year("ano_tri").isin(sorted(years)))


def lives(segmento, quarter, registro, n, operadora=None, modalidade=None, regiao=None):
    return (segmento, quarter, registro, operadora or f"op {registro}", modalidade, regiao, n)


def rows(df, *columns):
    """All rows as tuples of the named columns (all by default), in result order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def oracle(directory):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con
