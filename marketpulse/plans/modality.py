"""Lives by modality, and the market's growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import percent_change, ratio, round_to, scaled, sum_where
from marketpulse.functions.periods import long_label
from marketpulse.operators import crosstab
from marketpulse.operators.compare import compared_quarters, is_at, required
from marketpulse.plans.crosstabs import modality_columns
from marketpulse.schema import dimension
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import Category, SegmentSpec, pick, snapshots


def snapshot_indicators(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """One row per segment: market growth, and the headline modality's percentage.

    The percentage is rounded as a ratio and then multiplied, as published.
    """
    fact = inputs.enrolment(specs, {"modalidade"}, snapshots(specs, "prior", "current"))
    lives, now = F.col("beneficiarios"), is_at(specs, "current")
    headline = F.col("modalidade") == pick(specs, lambda s: s.headline.key)
    sums = fact.groupBy("segmento").agg(
        required(specs, "prior", sum_where(is_at(specs, "prior"), lives)).alias("before"),
        required(specs, "current", sum_where(now, lives)).alias("now"),
        sum_where(now & headline, lives).alias("headline"),
    )
    return sums.select(
        "segmento",
        percent_change(F.col("now"), F.col("before")).alias("totaltri"),
        (100 * round_to(ratio(F.col("headline"), F.col("now")), 3)).alias("modalidade_tri"),
    )


def total_growth(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Growth of all lives against the same quarter of the year before; needs no modality."""
    fact = inputs.enrolment(specs, set(), snapshots(specs, "prior", "current"))
    lives = F.col("beneficiarios")
    sums = fact.groupBy("segmento").agg(
        required(specs, "prior", sum_where(is_at(specs, "prior"), lives)).alias("before"),
        required(specs, "current", sum_where(is_at(specs, "current"), lives)).alias("now"),
    )
    growth = percent_change(F.col("now"), F.col("before"))
    return sums.select("segmento", growth.alias("totaltri"))


def modality_percentage(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return snapshot_indicators(inputs, specs).select("segmento", "modalidade_tri")


def _with_total(spec: SegmentSpec) -> tuple[Category, ...]:
    last = max(c.ordem for c in spec.modalities)
    return (*spec.modalities, Category(crosstab.MARGIN_COLUMN, "Total", last + 1))


def modality_compare(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Lives by modality and in total at the prior and the current quarter, in axis order."""
    fact = inputs.enrolment(specs, {"modalidade"}, snapshots(specs, "prior", "current"))
    table = crosstab.wide(fact, ["competencia"], "modalidade", modality_columns(specs))
    unit = pick(specs, lambda s: s.lives_unit)
    names = [c for c in table.columns if c not in ("segmento", "competencia")]
    table = table.withColumns({c: scaled(F.col(c), unit, 1) for c in names})
    rows = compared_quarters(table, specs, names, "coluna")
    return (
        rows.join(dimension(inputs.spark, specs, _with_total), ["segmento", "coluna"])
        .select("segmento", "ordem", F.col("rotulo").alias("modalidade"), "ant", "atu")
        .orderBy("segmento", "ordem")
    )


def period_labels(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Names of the compared quarters that have data, in time order."""
    fact = inputs.enrolment(specs, set(), snapshots(specs, "prior", "current"))
    compared = is_at(specs, "prior") | is_at(specs, "current")
    return (
        fact.filter(compared)
        .select("segmento", "competencia")
        .distinct()
        .select(
            "segmento",
            F.col("competencia").alias("trimestre"),
            long_label(F.col("competencia")).alias("rotulo"),
        )
        .orderBy("segmento", "trimestre")
    )
