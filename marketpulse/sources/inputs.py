"""What the jobs read: enrolment cuts, member lists and the ledger."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.schema import ENROLMENT, LEDGER
from marketpulse.sinks import partitions
from marketpulse.spec import SegmentSpec

DIMENSIONS = ("registro", "operadora", "modalidade", "regiao")


class Inputs(Protocol):
    spark: SparkSession

    def enrolment(
        self,
        specs: Sequence[SegmentSpec],
        dims: Collection[str],
        quarters: Collection[date],
    ) -> DataFrame:
        """segmento, competencia, the asked dimensions and beneficiarios; one or more rows per cell."""

    def held(
        self,
        specs: Sequence[SegmentSpec],
        dims: Collection[str],
        quarters: Collection[date],
        anchored: bool = False,
    ) -> DataFrame:
        """segmento, competencia: those of the quarters that such a request has data for.

        ``anchored`` asks for an error where nothing of a segment's anchor year is among them.
        """

    def serves(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> bool:
        """Whether one request has all that requests for fewer of the dimensions would have."""

    def members(self, specs: Sequence[SegmentSpec]) -> DataFrame:
        """segmento, registro, associada and the list's other columns, rows as loaded."""

    def ledger(
        self, specs: Sequence[SegmentSpec], years: Collection[int] | None = None
    ) -> DataFrame:
        """segmento, registro, modalidade, ano_tri, class_conta, saldo_cents."""


class MissingPeriod(LookupError):
    """A quarter that is to be compared, or the whole anchor year, has no data."""


def missing_anchor(spec: SegmentSpec) -> str:
    return f"{spec.segmento} has no data in its anchor year {spec.anchor_year}"


def compared_periods(
    specs: Sequence[SegmentSpec], quarters: Collection[date]
) -> list[tuple[str, date, str]]:
    """The compared quarters among those asked for: segment, quarter, and a text for when it is missing."""
    return [
        (s.segmento, getattr(s, name), f"{s.segmento} has no data for its {name} quarter {getattr(s, name)}")
        for s in specs
        for name in ("prior", "current")
        if getattr(s, name) in quarters
    ]


def known_quarters(sets: DataFrame, specs: Sequence[SegmentSpec], anchored: bool) -> DataFrame:
    """Rows (segmento, competencia) of the sets (segmento, held) of quarters, checked for the anchor year if asked."""
    held = F.col("held")
    for s in specs if anchored else ():
        anchor = F.array(*[F.lit(q) for q in s.anchor_quarters])
        lacks = (F.col("segmento") == s.segmento) & ~F.arrays_overlap(F.col("held"), anchor)
        error = F.raise_error(F.lit(f"{MissingPeriod.__name__}: {missing_anchor(s)}")).cast("array<date>")
        held = F.when(lacks, error).otherwise(held)
    return sets.select("segmento", F.explode(held).alias("competencia"))


@dataclass(frozen=True)
class Cut:
    """A landed part of the enrolment fact: the dimensions that it has, and where it lies.

    Cuts of the same dimensions may hold different quarters.
    """

    dims: frozenset[str]
    path: str


class LandedInputs:
    """Inputs that an earlier job landed as Parquet.

    ``enrolment`` lists cuts, or maps the dimensions of cuts to their paths. A
    request is served by the smallest cut that has all its dimensions and all
    of its quarters that any such cut has, so a joint fact alone is enough, and
    the marginal cuts of the published crosstabs are too. The cuts are
    partitioned by segment and quarter: what a cut holds is read from the names
    of its folders, and segment and period filters prune them.
    """

    def __init__(
        self,
        spark: SparkSession,
        enrolment: Mapping[frozenset[str], str] | Iterable[Cut],
        members: str,
        ledger: str,
    ) -> None:
        self.spark = spark
        if isinstance(enrolment, Mapping):
            enrolment = [Cut(dims, path) for dims, path in enrolment.items()]
        self._cuts = list(enrolment)
        self._held: dict[Cut, set[tuple[str, date]]] = {}
        self._members = members
        self._ledger = ledger

    @property
    def published_totals(self) -> bool:
        """Whether operators' totals lie apart from their cells."""
        return any(cut.dims <= {"registro", "operadora"} for cut in self._cuts)

    def _holds(self, cut: Cut) -> set[tuple[str, date]]:
        """Segments and quarters of a cut."""
        if cut not in self._held:
            self._held[cut] = {
                (p["segmento"], date.fromisoformat(p["competencia"]))
                for p in partitions(self.spark, cut.path)
            }
        return self._held[cut]

    def _choose(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> Cut:
        fitting = [cut for cut in self._cuts if cut.dims >= frozenset(dims)]
        if not fitting:
            raise LookupError(f"no landed cut has the dimensions {sorted(dims)}")
        wanted = {(s.segmento, q) for s in specs for q in quarters}
        known = wanted & set().union(*[self._holds(cut) for cut in fitting])
        for segmento, quarter, text in compared_periods(specs, quarters):
            if (segmento, quarter) not in known:
                raise MissingPeriod(text)
        whole = [cut for cut in fitting if self._holds(cut) >= known]
        if not whole:
            raise LookupError(f"no single cut with {sorted(dims)} holds all of {sorted(known)}")
        return min(whole, key=lambda c: (len(c.dims), sorted(c.dims), c.path))

    def held(
        self,
        specs: Sequence[SegmentSpec],
        dims: Collection[str],
        quarters: Collection[date],
        anchored: bool = False,
    ) -> DataFrame:
        """From the names of the chosen cut's folders: at most a row for each segment and quarter asked for."""
        known = self.pairs_held(specs, dims, quarters)
        for s in specs if anchored else ():
            if not known & {(s.segmento, q) for q in s.anchor_quarters}:
                raise MissingPeriod(missing_anchor(s))
        pairs = sorted(known)
        rows = [F.struct(F.lit(s).alias("segmento"), F.lit(q).alias("competencia")) for s, q in pairs]
        nothing = F.from_json(F.lit("[]"), "array<struct<segmento string, competencia date>>")
        return self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows) if rows else nothing))

    def pairs_held(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> set[tuple[str, date]]:
        """Segments and quarters of the request that are landed, known when the plan is made."""
        wanted = {(s.segmento, q) for s in specs for q in quarters}
        return wanted & self._holds(self._choose(specs, dims, quarters))

    def serves(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> bool:
        wanted = {(s.segmento, q) for s in specs for q in quarters}
        anywhere = wanted & set().union(*[self._holds(cut) for cut in self._cuts])
        return any(cut.dims >= frozenset(dims) and self._holds(cut) >= anywhere for cut in self._cuts)

    def enrolment(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> DataFrame:
        cut = self._choose(specs, dims, quarters)
        stored = [f for f in ENROLMENT if f.name not in DIMENSIONS or f.name in cut.dims]
        return (
            self.spark.read.schema(T.StructType(stored))
            .parquet(cut.path)
            .filter(F.col("segmento").isin([s.segmento for s in specs]))
            .filter(F.col("competencia").isin(sorted(quarters)))
            .select(
                "segmento",
                "competencia",
                *[d for d in DIMENSIONS if d in dims],
                "beneficiarios",
            )
        )

    def members(self, specs: Sequence[SegmentSpec]) -> DataFrame:
        return self.spark.read.parquet(self._members).filter(
            F.col("segmento").isin([s.segmento for s in specs])
        )

    def ledger(
        self, specs: Sequence[SegmentSpec], years: Collection[int] | None = None
    ) -> DataFrame:
        stored = T.StructType([*LEDGER, T.StructField("ano", T.IntegerType())])
        df = self.spark.read.schema(stored).parquet(self._ledger)
        df = df.filter(F.col("segmento").isin([s.segmento for s in specs]))
        if years is not None:
            df = df.filter(F.col("ano").isin(sorted(years)))
        return df.drop("ano")


class Replaced:
    """Inputs whose ledger or enrolment comes from given frames instead."""

    def __init__(
        self,
        inputs: Inputs,
        ledger: DataFrame | None = None,
        enrolment: Mapping[frozenset[str], DataFrame] | None = None,
    ) -> None:
        self.spark = inputs.spark
        self._inputs = inputs
        self._ledger = ledger
        self._facts = enrolment
        self.published_totals = any(d <= {"registro", "operadora"} for d in enrolment or ())

    def enrolment(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> DataFrame:
        if self._facts is None:
            return self._inputs.enrolment(specs, dims, quarters)
        chosen = min((d for d in self._facts if d >= frozenset(dims)), key=len)
        return self._facts[chosen].filter(
            F.col("segmento").isin([s.segmento for s in specs])
            & F.col("competencia").isin(sorted(quarters))
        ).select("segmento", "competencia", *[d for d in DIMENSIONS if d in dims], "beneficiarios")

    def held(
        self,
        specs: Sequence[SegmentSpec],
        dims: Collection[str],
        quarters: Collection[date],
        anchored: bool = False,
    ) -> DataFrame:
        if self._facts is None:
            return self._inputs.held(specs, dims, quarters, anchored)
        fact = self.enrolment(specs, dims, quarters)
        sets = fact.groupBy("segmento").agg(F.collect_set("competencia").alias("held"))
        return known_quarters(sets, specs, anchored)

    def serves(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> bool:
        if self._facts is None:
            return self._inputs.serves(specs, dims, quarters)
        return any(d >= frozenset(dims) for d in self._facts)

    def members(self, specs: Sequence[SegmentSpec]) -> DataFrame:
        return self._inputs.members(specs)

    def ledger(
        self, specs: Sequence[SegmentSpec], years: Collection[int] | None = None
    ) -> DataFrame:
        if self._ledger is None:
            return self._inputs.ledger(specs, years)
        df = self._ledger.filter(F.col("segmento").isin([s.segmento for s in specs]))
        return df if years is None else df.filter(F.year("ano_tri").isin(sorted(years)))


class Selected:
    """Inputs that hold some quarters only: as before the others were published, or for a part of a series."""

    def __init__(self, inputs: Inputs, quarters: Collection[date]) -> None:
        self.spark = inputs.spark
        self._inputs = inputs
        self._quarters = frozenset(quarters)
        self.published_totals = getattr(inputs, "published_totals", False)

    def enrolment(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> DataFrame:
        return self._inputs.enrolment(specs, dims, self._quarters & set(quarters))

    def held(
        self,
        specs: Sequence[SegmentSpec],
        dims: Collection[str],
        quarters: Collection[date],
        anchored: bool = False,
    ) -> DataFrame:
        for s in specs if anchored else ():
            if not self._quarters & set(s.anchor_quarters):
                raise MissingPeriod(missing_anchor(s))
        return self._inputs.held(specs, dims, self._quarters & set(quarters), anchored)

    def serves(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> bool:
        return self._inputs.serves(specs, dims, self._quarters & set(quarters))

    def members(self, specs: Sequence[SegmentSpec]) -> DataFrame:
        return self._inputs.members(specs)

    def ledger(
        self, specs: Sequence[SegmentSpec], years: Collection[int] | None = None
    ) -> DataFrame:
        return self._inputs.ledger(specs, years)
