"""The strip of headline figures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import (
    change,
    number_text,
    percent_change,
    ratio,
    round_to,
    scaled,
    sum_where,
)
from marketpulse.plans import enrolment, finance, individual, modality
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import SegmentSpec, one, snapshots

# What follows the number in each figure's text.
SUFFIXES = {
    "totaltri": "%",
    "modalidade_tri": "%",
    "fat_total": " bi",
    "fat_total_cres": "%",
    "desp_total": " bi",
    "desp_total_cres": "%",
    "n_associadas": "",
    "total_benef": " milhões",
    "var_a": "%",
    "perc_a": "%",
    "fat_var_1": "%",
    "fat_var_2": "%",
    "fat_var_3": "%",
}


def member_count(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Rows of each member list as loaded, matched to an operator or not."""
    return (
        inputs.members(specs)
        .groupBy("segmento")
        .agg(F.count(F.lit(1)).alias("n_associadas"))
    )


def _with_text(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """segmento, kpi, valor and the text of each figure."""

    def text(name: str) -> Column:
        x = F.col("valor")
        shown = round_to(100 * x, 1) if name == "perc_a" else x
        return F.concat(number_text(shown), F.lit(SUFFIXES[name]))

    return long.withColumn(
        "texto", F.coalesce(*[F.when(F.col("kpi") == n, text(n)) for n in names])
    )


def _rows(table: DataFrame) -> DataFrame:
    """One row per segment and figure: segmento, kpi, valor, texto."""
    names = [c for c in table.columns if c != "segmento"]
    table = table.withColumns({n: F.col(n).cast("double") for n in names})
    return _with_text(table.unpivot(["segmento"], names, "kpi", "valor"), names)


#: What the figures of lives need of an operator, and the quarters that they ask for.
LIVES_DIMENSIONS = ("registro", "operadora", "modalidade")


def _lives_quarters(specs: Sequence[SegmentSpec]) -> set[date]:
    anchor = {q for s in specs for q in s.anchor_quarters}
    return anchor | set(snapshots(specs, "prior", "current"))


def operator_measures(fact: DataFrame, specs: Sequence[SegmentSpec]) -> DataFrame:
    """One row per operator (registro), a column per segment and measure.

    The anchored panel knows operators by number and name, so the fact is summed
    to these first; both sums are partial, and the second is over operators.
    """
    lives = F.col("beneficiarios")
    first, second = [], []
    for s in specs:
        own = F.col("segmento") == s.segmento
        now, before = (own & (F.col("competencia") == F.lit(q)) for q in (s.current, s.prior))
        headline = F.col("modalidade") == s.headline.key
        measures = {
            "now": sum_where(now, lives),
            "before": sum_where(before, lives),
            "headline": sum_where(now & headline, lives),
            "rows_now": F.count_if(now),
            "rows_before": F.count_if(before),
            "anchored": F.max(own & (F.year("competencia") == s.anchor_year)),
        }
        if med := one(specs, individual.MEDICAL):
            # Members' own lives are those at the medical list's current quarter, in both segments.
            measures["paired"] = sum_where(own & (F.col("competencia") == F.lit(med[0].current)), lives)
        first += [c.alias(f"{n}_{s.segmento}") for n, c in measures.items()]

        def of(name: str, segmento: str = s.segmento) -> Column:
            return F.col(f"{name}_{segmento}")

        sums = {n: F.sum(of(n)) for n in measures if n != "anchored"}
        for n in ("now", "before"):
            sums[f"panel_{n}"] = F.sum(F.when(of("anchored"), F.coalesce(of(n), F.lit(0))))
        second += [c.alias(f"{n}_{s.segmento}") for n, c in sums.items()]
    operators = fact.groupBy("registro", "operadora").agg(*first)
    return operators.groupBy("registro").agg(*second)


def lives_figures(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Figures of market and member lives of every segment, from one pass over the fact.

    An operator's measures are joined to the member lists and summed to a single
    row, whose columns then become rows.
    """
    fact = inputs.enrolment(specs, LIVES_DIMENSIONS, _lives_quarters(specs))
    lists = inputs.members(specs).groupBy("registro").agg(
        *[F.max(F.col("segmento") == s.segmento).alias(f"member_{s.segmento}") for s in specs]
    )
    table = operator_measures(fact, specs).join(lists, "registro", "left")
    both = bool(one(specs, individual.MEDICAL) and one(specs, individual.DENTAL))
    sums = []
    for s in specs:
        seg = s.segmento
        member = F.col(f"member_{seg}")
        plain = ["now", "before", "headline", "rows_now", "rows_before", "panel_now", "panel_before"]
        sums += [F.sum(f"{n}_{seg}").alias(f"{n}_{seg}") for n in plain]
        sums += [sum_where(member, F.col(f"panel_{n}_{seg}")).alias(f"own_{n}_{seg}") for n in ("now", "before")]
        if both:
            listed = F.col(f"member_{individual.MEDICAL}") & (F.col(f"rows_now_{individual.MEDICAL}") > 0)
            sums.append(sum_where(listed, F.col(f"paired_{seg}")).alias(f"paired_{seg}"))
    figures = table.agg(*sums)
    rows = [row for s in specs for row in _figures_of(s, both)]
    found = figures.select(F.explode(F.array(*rows)).alias("f")).filter("f.known")
    long = found.select(F.col("f.segmento").alias("segmento"), F.col("f.kpi").alias("kpi"), F.col("f.valor").alias("valor"))
    return _with_text(long, ["totaltri", "modalidade_tri", "total_benef", "var_a", "perc_a"])


def _figures_of(spec: SegmentSpec, both: bool) -> list[Column]:
    """A segment's figures of lives as structs (segmento, kpi, valor, known); not known is what has no rows."""

    def of(name: str) -> Column:
        return F.col(f"{name}_{spec.segmento}")

    def missing(name: str, value: Column) -> Column:
        quarter = getattr(spec, name)
        text = F.lit(f"MissingPeriod: {spec.segmento} has no data for its {name} quarter {quarter}")
        none = of("rows_now" if name == "current" else "rows_before") == 0
        return F.when(any_rows & none, F.raise_error(text).cast("double")).otherwise(value)

    any_rows = of("rows_now") + of("rows_before") > 0
    in_panel = of("panel_now").isNotNull()
    unit = F.lit(spec.lives_unit)
    is_med = spec.segmento == individual.MEDICAL
    growth = percent_change(of("now"), of("before"))
    figures = {
        "totaltri": (any_rows, missing("prior", missing("current", growth))),
        "modalidade_tri": (any_rows, 100 * round_to(ratio(of("headline"), of("now")), 3)),
        "var_a": (in_panel, round_to(change(of("own_now"), of("own_before")) * 100, 1)),
    }
    # Members' lives count both segments for MED and their own for ODO; only MED shows coverage.
    if is_med:
        figures["perc_a"] = in_panel, ratio(of("own_now"), of("panel_now"))
        if both:
            paired = [F.coalesce(F.col(f"paired_{s}"), F.lit(0)) for s in (individual.MEDICAL, individual.DENTAL)]
            figures["total_benef"] = F.lit(True), scaled(paired[0] + paired[1], unit, 1)
    else:
        figures["total_benef"] = in_panel, scaled(of("own_now"), unit, 1)
    return [
        F.struct(
            F.lit(spec.segmento).alias("segmento"),
            F.lit(kpi).alias("kpi"),
            value.cast("double").alias("valor"),
            F.coalesce(known, F.lit(False)).alias("known"),
        )
        for kpi, (known, value) in figures.items()
    ]


def _lives_apart(inputs: Inputs, specs: Sequence[SegmentSpec]) -> list[DataFrame]:
    """The figures of lives, each from the cut that was published for it."""
    series = enrolment.series_indicators(inputs, specs)
    med, odo = individual.MEDICAL, individual.DENTAL
    is_med = F.col("segmento") == med
    own_lives = _rows(series.select("segmento", "total_benef", "var_a", "perc_a")).filter(
        ~(is_med & (F.col("kpi") == "total_benef")) & (is_med | (F.col("kpi") != "perc_a"))
    )
    parts = [_rows(modality.snapshot_indicators(inputs, specs)), own_lives]
    if one(specs, med) and one(specs, odo):
        parts.append(_rows(individual.members_lives(inputs, specs)))
    return parts


def kpi_table(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Every headline figure of every segment.

    Two passes over the facts: one aggregation of lives by operator and one of the
    ledger. Where no single cut of the lives has it all, each figure takes its own.
    """
    if inputs.serves(specs, LIVES_DIMENSIONS, _lives_quarters(specs)):
        lives = [lives_figures(inputs, specs)]
    else:
        lives = _lives_apart(inputs, specs)
    parts = [
        *lives,
        _rows(finance.finance_indicators(inputs, specs)),
        _rows(member_count(inputs, specs)),
    ]
    return reduce(DataFrame.unionByName, parts)
