"""The crosstabs that the market reports start from, cut out of the enrolment fact."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.periods import label, label_of
from marketpulse.operators import crosstab
from marketpulse.operators.members import flag_members
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import (
    UNIDENTIFIED_REGION,
    Category,
    SegmentSpec,
    all_quarters,
    snapshots,
)

OPERATOR = ("registro", "operadora")


def columns_of(
    specs: Sequence[SegmentSpec], categories: Callable[[SegmentSpec], Sequence[Category]]
) -> list[tuple[object, str]]:
    """(value, column) of every category of any segment, in order of first appearance."""
    seen = {c.key: c.column for s in specs for c in categories(s)}
    return list(seen.items())


def modality_columns(specs: Sequence[SegmentSpec]) -> list[tuple[object, str]]:
    return columns_of(specs, lambda s: s.modalities)


def region_columns(specs: Sequence[SegmentSpec]) -> list[tuple[object, str]]:
    return columns_of(specs, lambda s: s.regions)


def margins(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Period by modality, long, with all margins."""
    fact = inputs.enrolment(specs, {"modalidade"}, all_quarters(specs))
    return crosstab.with_margins(fact, "competencia", "modalidade")


def period_by_modality(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    fact = inputs.enrolment(specs, {"modalidade"}, all_quarters(specs))
    table = crosstab.wide(fact, ["competencia"], "modalidade", modality_columns(specs))
    return table.withColumnRenamed("competencia", "trimestre")


def period_by_region(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    fact = inputs.enrolment(specs, {"regiao"}, all_quarters(specs))
    columns = [*region_columns(specs), (UNIDENTIFIED_REGION, UNIDENTIFIED_REGION)]
    table = crosstab.wide(fact, ["competencia"], "regiao", columns)
    return table.withColumnRenamed("competencia", "trimestre")


def operator_by_period(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """One column per quarter, named as in the published table (mar_15, jun_15, ...)."""
    quarters = all_quarters(specs)
    fact = inputs.enrolment(specs, OPERATOR, quarters)
    return crosstab.wide(fact, OPERATOR, "competencia", [(q, label_of(q)) for q in quarters])


def operator_by_modality(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Snapshots of the current and the prior-year quarter, with the member flag."""
    fact = inputs.enrolment(specs, {*OPERATOR, "modalidade"}, snapshots(specs, "current", "prior"))
    table = crosstab.wide(
        fact, ["competencia", *OPERATOR], "modalidade", modality_columns(specs)
    )
    return flag_members(table, inputs.members(specs))


def operator_total(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Operator totals of the two compared quarters, with the member flag."""
    fact = inputs.enrolment(specs, {"registro"}, snapshots(specs, "current", "prior"))
    total = fact.groupBy("segmento", "competencia", "registro").agg(
        F.sum("beneficiarios").alias("total")
    )
    return flag_members(total, inputs.members(specs))


def operator_by_region(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Snapshot of the current quarter, with the member flag."""
    fact = inputs.enrolment(specs, {*OPERATOR, "regiao"}, snapshots(specs, "current"))
    columns = [*region_columns(specs), (UNIDENTIFIED_REGION, UNIDENTIFIED_REGION)]
    table = crosstab.wide(fact, OPERATOR, "regiao", columns)
    return flag_members(table, inputs.members(specs))


def text_extract(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Period by region as published: period labels, texts, '-' for no data, both margins."""
    fact = inputs.enrolment(specs, {"regiao"}, all_quarters(specs))
    columns = [*region_columns(specs), (UNIDENTIFIED_REGION, UNIDENTIFIED_REGION)]
    table = crosstab.wide(fact, ["competencia"], "regiao", columns)
    table = table.withColumn("competencia", label(F.col("competencia")))
    table = crosstab.add_margin_row(table, "competencia")
    cells = [c for c in table.columns if c not in ("segmento", "competencia")]
    return table.select(
        "segmento",
        "competencia",
        *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in cells],
    )


def extract_round_trip(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """One extract per segment, joined by name and read back to a long fact.

    The last segment's extract comes without the column of unidentified regions.
    """
    extracts = [text_extract(inputs, (s,)) for s in specs]
    if len(extracts) > 1:
        extracts[-1] = extracts[-1].drop(UNIDENTIFIED_REGION)
    fact = crosstab.to_fact(crosstab.union_extracts(extracts), "regiao", keep_missing=False)
    keys = columns_of(specs, lambda s: s.regions)
    name = F.coalesce(
        *[F.when(F.col("regiao") == column, F.lit(key)) for key, column in keys],
        F.col("regiao"),
    )
    return fact.withColumn("regiao", name)
