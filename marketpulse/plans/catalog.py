"""Every named result and the job that builds it."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from marketpulse.plans import (
    crosstabs,
    enrolment,
    finance,
    individual,
    kpi,
    modality,
    readers,
    region,
)
from marketpulse.operators.members import flag_members
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import SegmentSpec, later, one, snapshots

Job = Callable[[Inputs, Sequence[SegmentSpec]], DataFrame]


def _med(job: Job) -> Job:
    return lambda inputs, specs: job(inputs, one(specs, "MED"))


def _odo(job: Job) -> Job:
    return lambda inputs, specs: job(inputs, one(specs, "ODO"))


def member_list(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    return inputs.members(specs)


def member_flag(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """The flag of every operator of the two compared snapshots."""
    fact = inputs.enrolment(specs, {"registro"}, snapshots(specs, "current", "prior"))
    operators = fact.select("segmento", "competencia", "registro").distinct()
    return flag_members(operators, inputs.members(specs))


JOBS: dict[str, Job] = {
    "q01_crosstab_to_fact": crosstabs.extract_round_trip,
    "q02_crosstab_margins": crosstabs.margins,
    "q02a_period_by_modality": crosstabs.period_by_modality,
    "q02b_period_by_region": crosstabs.period_by_region,
    "q02c_operator_by_period": crosstabs.operator_by_period,
    "q02d_operator_by_modality": crosstabs.operator_by_modality,
    "q02e_operator_total": crosstabs.operator_total,
    "q02f_operator_by_region": crosstabs.operator_by_region,
    "q03_members": member_list,
    "q04_ledger_wide": _med(finance.ledger_wide),
    "q05_member_flag": member_flag,
    "q06_anchor_panel": enrolment.operator_panel,
    "q07_market_total": enrolment.market_total,
    "q08_member_total": enrolment.member_total,
    "q09_market_yoy": enrolment.market_yoy,
    "q10_share_modality": _med(enrolment.share_of_headline),
    "q10o_share_modality": _odo(enrolment.share_of_headline),
    "q11_share_total": _odo(enrolment.share_of_total),
    "q12_result_med": _med(finance.operating_result),
    "q13_result_odo": _odo(finance.operating_result),
    "q14_finance_year": finance.finance_year,
    "q15_finance_compare": finance.finance_compare,
    "q16_finance_members": finance.finance_members,
    "q17_finance_modality": _med(finance.finance_modality),
    "q18_finance_total": _odo(finance.finance_total),
    "q19_member_region": region.member_region,
    "q20_region_share": region.region_share,
    "q21_total_growth": modality.total_growth,
    "q22_modality_pct": modality.modality_percentage,
    "q23_finance_cells": finance.finance_cells,
    "q24_region_compare": region.region_compare,
    "q25_region_yoy": region.region_yoy,
    "q26_modality_compare": modality.modality_compare,
    "q27_individual": individual.individual,
    "q28_individual_total": individual.individual_total,
    "q29_members_lives_med": individual.members_lives,
    "q30_members_lives_odo": _odo(enrolment.members_lives),
    "q31_member_growth": enrolment.member_growth,
    "q32_member_coverage": _med(enrolment.member_coverage),
    "q33_finance_var": finance.finance_var,
    "q34_finance_var_cells": finance.finance_var_cells,
    "q35_finance_var_ordered": finance.finance_var_ordered,
    "q36_period_labels": modality.period_labels,
    "q37_finance_series": finance.finance_series,
    "q38_finance_growth": finance.finance_growth,
    "q39_member_count": kpi.member_count,
    "q40_share_labels": enrolment.share_labels,
    "q42_kpi_table": kpi.kpi_table,
    "q43_result_long_layout": _med(readers.result_of_long_layout),
    "q44_result_wide_layout": _odo(readers.result_of_wide_layout),
    "q45_share_of_requests": _odo(readers.share_of_requests),
    "q46_share_with_gaps": readers.share_with_gaps,
    "q47_yoy_with_gap": readers.yoy_with_gap,
}

#: Segments without which a job has no result; the others take either segment alone.
_ONLY_MED = (
    "q04_ledger_wide",
    "q10_share_modality",
    "q12_result_med",
    "q17_finance_modality",
    "q32_member_coverage",
    "q43_result_long_layout",
)
_ONLY_ODO = (
    "q10o_share_modality",
    "q11_share_total",
    "q13_result_odo",
    "q18_finance_total",
    "q30_members_lives_odo",
    "q44_result_wide_layout",
    "q45_share_of_requests",
)
_BOTH = ("q27_individual", "q28_individual_total", "q29_members_lives_med", "q42_kpi_table")
NEEDS: dict[str, frozenset[str]] = {
    **{name: frozenset({"MED"}) for name in _ONLY_MED},
    **{name: frozenset({"ODO"}) for name in _ONLY_ODO},
    **{name: frozenset({"MED", "ODO"}) for name in _BOTH},
}



@dataclass(frozen=True)
class Series:
    """A result with a row or more for each quarter, which can be built for some quarters alone.

    ``time`` is the column of the quarter, ``month`` what is added to its first
    month there. A quarter reaches the results of itself and of as many quarters
    later as ``reach`` says. An ``anchored`` result depends on the whole anchor
    year. A ``counted`` one counts rows back, so it is built in part only where
    the quarters around have no gap.
    """

    time: str
    reach: tuple[int, ...] = (0,)
    month: int = 0
    anchored: bool = False
    counted: bool = False


SERIES: dict[str, Series] = {
    "q02a_period_by_modality": Series("trimestre"),
    "q02b_period_by_region": Series("trimestre"),
    "q06_anchor_panel": Series("competencia", anchored=True),
    "q07_market_total": Series("trimestre", anchored=True),
    "q08_member_total": Series("trimestre", anchored=True),
    "q09_market_yoy": Series("trimestre", (0, 4), anchored=True),
    "q25_region_yoy": Series("trimestre", (0, 4), month=2, counted=True),
}

#: Results that no quarter of the enrolment reaches: they come from the ledger or the member lists alone.
_WITHOUT_ENROLMENT = (
    "q03_members",
    "q04_ledger_wide",
    *[n for n in JOBS if n[:3] in ("q12", "q13", "q14", "q15", "q16", "q17", "q18", "q23", "q33", "q34", "q35", "q37", "q38")],
    "q39_member_count",
    "q43_result_long_layout",
    "q44_result_wide_layout",
)
#: Results over every requested quarter, that are no series.
_OF_ALL_QUARTERS = ("q01_crosstab_to_fact", "q02_crosstab_margins", "q02c_operator_by_period", "q47_yoy_with_gap")
#: Results of the compared quarters that use the anchored panel too.
_OF_PANEL = ("q30_members_lives_odo", "q31_member_growth", "q32_member_coverage", "q42_kpi_table")


def reached(name: str, specs: Sequence[SegmentSpec], quarters: Collection[date]) -> frozenset[date] | None:
    """The quarters of a result that these quarters of the enrolment reach; None if they reach all of it.

    A result that is no series is reached wholly or, with an empty set, not at all.
    """
    anchor = {q for s in specs for q in s.anchor_quarters}
    if name in SERIES:
        series = SERIES[name]
        if series.anchored and anchor & set(quarters):
            return None
        return frozenset(later(q, k) for q in quarters for k in series.reach)
    if name in _WITHOUT_ENROLMENT:
        return frozenset()
    if name in _OF_ALL_QUARTERS:
        return None
    needed = set(snapshots(specs, "prior", "current")) | (anchor if name in _OF_PANEL else set())
    return None if needed & set(quarters) else frozenset()


def lacks(name: str, specs: Sequence[SegmentSpec]) -> frozenset[str]:
    """Segments that the job needs and that are not among the specs."""
    return NEEDS.get(name, frozenset()) - {s.segmento for s in specs}
