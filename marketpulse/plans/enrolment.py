"""Market and member lives on the anchored operator panel."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.numeric import (
    guarded_sum,
    percent_text,
    ratio,
    round_to,
    scaled,
    share_of,
    sum_where,
)
from marketpulse.operators.compare import is_at, series, since_last_year
from marketpulse.operators.members import (
    anchored_panel,
    flag_members,
    keep_held,
    keep_requested,
    panel_rows,
)
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import SegmentSpec, all_quarters, pick, snapshots


def _flagged_panel(
    inputs: Inputs, specs: Sequence[SegmentSpec], quarters: Sequence[date]
) -> tuple[DataFrame, DataFrame]:
    """The panel, a row per operator and a column per quarter, with the member flag; and the quarters held."""
    anchor = {q for s in specs for q in s.anchor_quarters}
    request = (specs, {"registro", "operadora"}, anchor | set(quarters))
    panel = anchored_panel(inputs.enrolment(*request), specs, quarters)
    return flag_members(panel, inputs.members(specs)), inputs.held(*request, anchored=True)


def operator_panel(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Every anchored operator in every requested quarter that is held, 0 where it has no lives."""
    quarters = all_quarters(specs)
    panel, held = _flagged_panel(inputs, specs, quarters)
    rows = panel_rows(panel, quarters).withColumn("competencia", F.col("competencia").cast("date"))
    return keep_held(keep_requested(rows, specs, quarters), held).select(
        "segmento", "registro", "operadora", "associada", "competencia", "beneficiarios"
    )


def market_series(
    inputs: Inputs, specs: Sequence[SegmentSpec], quarters: Sequence[date] | None = None
) -> DataFrame:
    """segmento, competencia, mercado, associadas over the panel.

    ``associadas`` is null throughout when no member is in the panel, and 0 in
    a quarter in which the panel's members have no lives. Operators are summed
    by their flag before the quarters become rows. A quarter that is not held has
    no row.
    """
    quarters = quarters or all_quarters(specs)
    panel, held = _flagged_panel(inputs, specs, quarters)
    sums = [F.sum(q.isoformat()).alias(q.isoformat()) for q in quarters]
    rows = panel_rows(panel.groupBy("segmento", "associada").agg(*sums), quarters)
    lives = F.col("beneficiarios")
    totals = rows.groupBy("segmento", "competencia").agg(
        F.sum(lives).alias("mercado"),
        sum_where(F.col("associada") == 1, lives).alias("associadas"),
    )
    totals = totals.withColumn("competencia", F.col("competencia").cast("date"))
    return keep_held(keep_requested(totals, specs, quarters), held)


def market_total(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return market_series(inputs, specs).select(
        "segmento",
        F.col("competencia").alias("trimestre"),
        F.col("mercado").alias("beneficiarios"),
    )


def member_total(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return (
        market_series(inputs, specs)
        .filter("associadas IS NOT NULL")
        .select(
            "segmento",
            F.col("competencia").alias("trimestre"),
            F.col("associadas").alias("beneficiarios"),
        )
    )


def with_yearly_change(totals: DataFrame) -> DataFrame:
    over = series("segmento")
    return totals.withColumns(
        {
            "var_tri_assoc": since_last_year("associadas", over),
            "var_tri_mercado": since_last_year("mercado", over),
        }
    )


def market_yoy(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Market and member lives with their change over four quarters."""
    table = with_yearly_change(market_series(inputs, specs))
    late = F.year("competencia") > pick(specs, lambda s: s.yoy_after_year)
    return (
        table.filter(late)
        .withColumnRenamed("competencia", "trimestre")
        .orderBy("segmento", "trimestre")
    )


def series_indicators(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """One row per segment: member lives, member growth and coverage at the current quarter.

    Reads the anchor year and the two compared quarters.
    """
    table = with_yearly_change(market_series(inputs, specs, snapshots(specs, "prior", "current")))
    return table.filter(is_at(specs, "current")).select(
        "segmento",
        scaled(F.col("associadas"), pick(specs, lambda s: s.lives_unit), 1).alias("total_benef"),
        round_to(F.col("var_tri_assoc") * 100, 1).alias("var_a"),
        ratio(F.col("associadas"), F.col("mercado")).alias("perc_a"),
    )


def members_lives(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return series_indicators(inputs, specs).select("segmento", "total_benef")


def member_growth(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return series_indicators(inputs, specs).select("segmento", "var_a")


def member_coverage(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    box = percent_text(round_to(100 * F.col("perc_a"), 1))
    return series_indicators(inputs, specs).select("segmento", "perc_a", box.alias("texto"))


def share_by_flag(fact: DataFrame, members: DataFrame, wanted: Column) -> DataFrame:
    """Members' and others' lives in the ``wanted`` rows of one snapshot, and their shares.

    A missing count anywhere in a group makes its sum missing, and with it every share.
    """
    lives = F.col("beneficiarios")
    # An operator that has rows, but no wanted ones, has 0 lives there.
    none = F.count_if(wanted) == 0
    by_operator = fact.groupBy("segmento", "registro").agg(
        F.when(none, F.lit(0)).otherwise(guarded_sum(lives, wanted)).alias("beneficiarios")
    )
    groups = (
        flag_members(by_operator, members)
        .groupBy("segmento", "associada")
        .agg(guarded_sum(lives).alias("beneficiarios"))
    )
    share = share_of(lives, Window.partitionBy("segmento"))
    return groups.withColumn("percentual", share)


def _is_headline(spec: SegmentSpec) -> Column:
    return F.col("modalidade") == spec.headline.key


def share_of_headline(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Members' share of the headline modality."""
    fact = inputs.enrolment(specs, {"registro", "modalidade"}, snapshots(specs, "current"))
    fact = fact.filter(is_at(specs, "current"))
    return share_by_flag(fact, inputs.members(specs), pick(specs, _is_headline))


def share_of_total(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Members' share of all lives of the segment."""
    fact = inputs.enrolment(specs, {"registro"}, snapshots(specs, "current"))
    fact = fact.filter(is_at(specs, "current"))
    return share_by_flag(fact, inputs.members(specs), F.lit(True))


def share_labels(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """The share that each segment's page shows, with its labels.

    The medical page shows the headline modality, the dental one all lives, from
    the published totals where there are any.
    """
    if getattr(inputs, "published_totals", False):
        headline = [s for s in specs if s.share_of_headline]
        total = [s for s in specs if not s.share_of_headline]
        parts = [share_of_headline(inputs, headline)] if headline else []
        parts += [share_of_total(inputs, total)] if total else []
        shares = reduce(DataFrame.unionByName, parts)
    else:  # both come from the same rows, in one pass
        fact = inputs.enrolment(specs, {"registro", "modalidade"}, snapshots(specs, "current"))
        fact = fact.filter(is_at(specs, "current"))
        wanted = pick(specs, lambda s: _is_headline(s) if s.share_of_headline else F.lit(True))
        shares = share_by_flag(fact, inputs.members(specs), wanted)
    name = F.when(F.col("associada") == 1, "Associadas").otherwise("Não associadas")
    return shares.withColumn("associada", name)
