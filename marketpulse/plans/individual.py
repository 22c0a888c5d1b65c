"""Performance of each member of the medical association."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import percent_change, percent_text, scaled, sum_where
from marketpulse.operators.members import append_total, member_ids
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import SegmentSpec

MEDICAL, DENTAL = "MED", "ODO"
LIVES = ("beneficiarios_medicos", "beneficiarios_odonto")


def _specs(specs: Sequence[SegmentSpec]) -> tuple[SegmentSpec, SegmentSpec]:
    by_name = {s.segmento: s for s in specs}
    return by_name[MEDICAL], by_name[DENTAL]


def performance(fact: DataFrame, members: DataFrame, med: SegmentSpec) -> DataFrame:
    """Medical and dental lives of each member now, and their change over a year.

    All four measures come from one aggregation by operator. Operators without
    a current medical row are left out. No medical figure to compare with gives
    0%, no dental one gives '-'.
    """

    def lives(segmento: str, quarter: date) -> Column:
        at = (F.col("segmento") == segmento) & (F.col("competencia") == F.lit(quarter))
        return sum_where(at, F.col("beneficiarios"))

    now = (F.col("segmento") == MEDICAL) & (F.col("competencia") == F.lit(med.current))
    measures = fact.groupBy("registro").agg(
        F.max(F.when(now, F.col("operadora"))).alias("operadora"),
        F.count_if(now).alias("rows"),
        lives(MEDICAL, med.current).alias("med"),
        lives(MEDICAL, med.prior).alias("med_before"),
        lives(DENTAL, med.current).alias("odo"),
        lives(DENTAL, med.prior).alias("odo_before"),
    )
    ids = member_ids(members).filter(F.col("segmento") == MEDICAL).select("registro")
    med_change = F.coalesce(percent_change(F.col("med"), F.col("med_before")), F.lit(0.0))
    odo_change = percent_change(F.col("odo"), F.col("odo_before"))
    return (
        measures.filter("rows > 0")
        .join(ids, "registro", "left_semi")
        .select(
            "registro",
            "operadora",
            F.coalesce("med", F.lit(0)).alias("beneficiarios_medicos"),
            percent_text(med_change).alias("variacao_anual_medico"),
            F.coalesce("odo", F.lit(0)).alias("beneficiarios_odonto"),
            F.coalesce(percent_text(odo_change), F.lit("-")).alias("variacao_anual_odonto"),
        )
    )


def individual(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    med, _ = _specs(specs)
    fact = inputs.enrolment(specs, {"registro", "operadora"}, {med.current, med.prior})
    return performance(fact, inputs.members((med,)), med)


def individual_total(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """``individual`` with a closing TOTAL row."""
    blank = {"operadora": "", "variacao_anual_medico": "", "variacao_anual_odonto": ""}
    return append_total(individual(inputs, specs), LIVES, {"registro": "TOTAL", **blank})


def members_lives(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Medical and dental lives of the members together."""
    med, _ = _specs(specs)
    total = individual(inputs, specs).agg(
        (F.coalesce(F.sum(LIVES[0]), F.lit(0)) + F.coalesce(F.sum(LIVES[1]), F.lit(0))).alias("n")
    )
    value = scaled(F.col("n"), F.lit(med.lives_unit), 1)
    return total.select(F.lit(MEDICAL).alias("segmento"), value.alias("total_benef"))
