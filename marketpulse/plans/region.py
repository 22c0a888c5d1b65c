"""Lives by macro-region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import guarded_sum, percent_text, ratio, round_to, scaled
from marketpulse.functions.periods import closing_month
from marketpulse.operators import crosstab
from marketpulse.operators.compare import compared_quarters, is_at, series, year_over_year
from marketpulse.operators.members import flag_members
from marketpulse.plans.crosstabs import region_columns
from marketpulse.schema import dimension
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import SegmentSpec, all_quarters, pick, snapshots


def _regions(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    dim = dimension(inputs.spark, specs, lambda s: s.regions)
    return dim.withColumnRenamed("chave", "regiao")


def region_snapshot(fact: DataFrame, members: DataFrame, regions: DataFrame) -> DataFrame:
    """Market and member lives of every region; regions without data stay, with nulls."""
    by_operator = fact.groupBy("segmento", "registro", "regiao").agg(
        guarded_sum(F.col("beneficiarios")).alias("beneficiarios")
    )
    lives, is_member = F.col("beneficiarios"), F.col("associada") == 1
    by_region = (
        flag_members(by_operator, members)
        .groupBy("segmento", "regiao")
        .agg(
            F.sum(lives).alias("benef"),
            guarded_sum(lives, is_member).alias("benef_associadas"),
        )
    )
    return regions.join(by_region, ["segmento", "regiao"], "left")


def _snapshot(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    fact = inputs.enrolment(specs, {"registro", "regiao"}, snapshots(specs, "current"))
    fact = fact.filter(is_at(specs, "current"))
    return region_snapshot(fact, inputs.members(specs), _regions(inputs, specs))


def member_region(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return _snapshot(inputs, specs).select("segmento", "regiao", "benef_associadas")


def rate_regions(snapshot: DataFrame) -> DataFrame:
    """Members' share of each region, highest first, with the text drawn on a map."""
    taxa = ratio(F.col("benef_associadas"), F.col("benef"))
    return (
        snapshot.withColumn("taxa", taxa)
        .select(
            "segmento",
            F.col("codigo").alias("code_region"),
            F.col("rotulo").alias("regiao"),
            "benef",
            "benef_associadas",
            "taxa",
            percent_text(round_to(F.col("taxa") * 100, 1)).alias("rotulo"),
        )
        .orderBy("segmento", F.desc_nulls_last("taxa"))
    )


def region_share(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return rate_regions(_snapshot(inputs, specs))


def region_compare(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Lives by region at the prior and the current quarter, in axis order."""
    fact = inputs.enrolment(specs, {"regiao"}, snapshots(specs, "prior", "current"))
    columns = region_columns(specs)
    table = crosstab.wide(fact, ["competencia"], "regiao", columns).drop(crosstab.MARGIN_COLUMN)
    unit = pick(specs, lambda s: s.lives_unit)
    names = [name for _, name in columns]
    table = table.withColumns({c: scaled(F.col(c), unit, 1) for c in names})
    rows = compared_quarters(table, specs, names, "coluna")
    return (
        rows.join(_regions(inputs, specs), ["segmento", "coluna"])
        .select("segmento", "ordem", F.col("rotulo").alias("regioes"), "ant", "atu")
        .orderBy("segmento", "ordem")
    )


def region_yoy(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Change over four quarters, one column per region, without the base year."""
    fact = inputs.enrolment(specs, {"regiao"}, all_quarters(specs))
    columns = region_columns(specs)
    table = crosstab.wide(fact, ["competencia"], "regiao", columns)
    over = series("segmento")
    changes = [year_over_year(name, over).alias(name) for _, name in columns]
    return (
        table.select("segmento", "competencia", *changes)
        .filter(F.year("competencia") != pick(specs, lambda s: s.region_base_year))
        .withColumn("competencia", closing_month(F.col("competencia")))
        .withColumnRenamed("competencia", "trimestre")
        .orderBy("segmento", "trimestre")
    )
