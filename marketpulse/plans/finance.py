"""Ledger roll-ups: operating result, yearly totals, two-year comparisons."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import (
    percent_change,
    round_to,
    scaled,
    sum_or_zero,
    sum_where,
)
from marketpulse.operators.compare import is_fin_year, is_year, transpose
from marketpulse.operators.members import flag_members
from marketpulse.schema import dimension
from marketpulse.sources.inputs import Inputs
from marketpulse.spec import Category, SegmentSpec, pick

POSITION = ("registro", "modalidade", "ano_tri")
METRICS = ("receita_de_contraprestacoes", "despesa_assistencial", "resultado_operacional")


def _roles(specs: Sequence[SegmentSpec]) -> list[str]:
    return list(dict.fromkeys(a.papel for s in specs for a in s.accounts))


def by_account(
    ledger: DataFrame, specs: Sequence[SegmentSpec], keys: Sequence[str]
) -> DataFrame:
    """The ledger summed by segment and ``keys``, one column per account role.

    The accounts are known, so the pivot is one aggregation with partial sums.
    A missing account stays null. A segment's result uses its own roles only,
    so a role may collect the accounts of every segment.
    """
    contas = {
        r: sorted({a.conta for s in specs for a in s.accounts if a.papel == r})
        for r in _roles(specs)
    }
    return ledger.groupBy("segmento", *keys).agg(
        *[
            sum_where(F.col("class_conta").isin(names), F.col("saldo_cents")).alias(r)
            for r, names in contas.items()
        ]
    )


def _result(spec: SegmentSpec) -> Column:
    """Signed sum of the segment's accounts; a missing one counts as 0 or voids the sum."""

    def term(papel: str, sinal: int) -> Column:
        x = F.coalesce(F.col(papel), F.lit(0)) if spec.missing_account_is_zero else F.col(papel)
        return x if sinal > 0 else -x

    return reduce(lambda a, b: a + b, [term(a.papel, a.sinal) for a in spec.accounts])


def positions(ledger: DataFrame, specs: Sequence[SegmentSpec]) -> DataFrame:
    """One row per operator, modality and quarter, one column per account role."""
    return by_account(ledger, specs, POSITION)


def with_result(table: DataFrame, specs: Sequence[SegmentSpec]) -> DataFrame:
    return table.withColumn("res_op", pick(specs, _result))


def ledger_wide(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """The ledger with one column per account of one segment, under the account's own name."""
    (spec,) = specs
    table = positions(inputs.ledger(specs), specs)
    if spec.missing_account_is_zero:
        table = table.fillna(0, subset=_roles(specs))
    return table.withColumnsRenamed({a.papel: a.conta for a in spec.accounts})


def operating_result(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """``ledger_wide`` with the year and the operating result of each row."""
    (spec,) = specs
    table = with_result(positions(inputs.ledger(specs), specs), specs)
    table = table.withColumn("ano", F.year("ano_tri"))
    if spec.missing_account_is_zero:
        table = table.fillna(0, subset=_roles(specs))
    return table.withColumnsRenamed({a.papel: a.conta for a in spec.accounts})


def yearly(rows: DataFrame, where: Column | None = None, prefix: str = "") -> list[Column]:
    """Sums of a year in cents: income, expense, result and shared income; nothing sums to 0."""

    def total(name: str) -> Column:
        x = F.col(name)
        return sum_or_zero(x if where is None else F.when(where, x))

    return [
        total("receita").alias(f"{prefix}receita"),
        total("corresponsabilidade").alias(f"{prefix}corresponsabilidade"),
        total("despesa").alias(f"{prefix}despesa"),
        total("res_op").alias(f"{prefix}res_op"),
    ]


def published(
    specs: Sequence[SegmentSpec], net: bool, digits: int, prefix: str = ""
) -> dict[str, Column]:
    """The three metrics in the reporting unit; ``net`` income includes the shared part."""
    income = F.col(f"{prefix}receita")
    if net:
        income = income + F.col(f"{prefix}corresponsabilidade")
    unit = pick(specs, lambda s: s.money_cents)
    cents = (income, F.col(f"{prefix}despesa"), F.col(f"{prefix}res_op"))
    return {f"{prefix}{m}": scaled(c, unit, digits) for m, c in zip(METRICS, cents)}


def _fin_years(specs: Sequence[SegmentSpec]) -> set[int]:
    return {y for s in specs for y in s.fin_years}


def yearly_rows(
    ledger: DataFrame, specs: Sequence[SegmentSpec], by_operator: bool = False
) -> DataFrame:
    """Rows to be summed by year, with their operating result.

    Where a missing account voids the result, they are whole positions. Where
    it counts as 0 the result is additive, so those segments are summed to
    years (and operators, if asked for) in the same aggregation, before
    anything is shuffled.
    """
    voids = [s.segmento for s in specs if not s.missing_account_is_zero]
    needed = F.col("segmento").isin(voids)
    masked = [c for c in POSITION if not (by_operator and c == "registro")]
    ledger = ledger.withColumn("ano", F.year("ano_tri"))
    ledger = ledger.withColumns({c: F.when(needed, F.col(c)) for c in masked})
    return with_result(by_account(ledger, specs, ("ano", *POSITION)), specs)


def _rows(
    inputs: Inputs,
    specs: Sequence[SegmentSpec],
    years: Collection[int] | None = None,
    by_operator: bool = False,
) -> DataFrame:
    return yearly_rows(inputs.ledger(specs, years), specs, by_operator)


def finance_year(
    inputs: Inputs, specs: Sequence[SegmentSpec], years: Collection[int] | None = None
) -> DataFrame:
    """Net income, expense and result of every year."""
    rows = _rows(inputs, specs, years)
    sums = rows.groupBy("segmento", "ano").agg(*yearly(rows))
    return sums.select(
        "segmento",
        "ano",
        *[c.alias(n) for n, c in published(specs, net=True, digits=1).items()],
    )


def finance_compare(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """``finance_year`` of the two compared years."""
    return finance_year(inputs, specs, _fin_years(specs)).filter(is_fin_year(specs))


def finance_series(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """``finance_year`` as (segmento, ano, tipo, valor) with display names."""
    table = finance_year(inputs, specs)
    long = table.unpivot(["segmento", "ano"], list(METRICS), "coluna", "valor")
    return (
        long.join(_metric_names(inputs, specs), ["segmento", "coluna"])
        .select("segmento", "ano", "ordem", F.col("rotulo").alias("tipo"), "valor")
    )


def finance_members(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Gross income, expense and result of the members in the two compared years."""
    rows = _rows(inputs, specs, _fin_years(specs), by_operator=True).filter(is_fin_year(specs))
    rows = flag_members(rows, inputs.members(specs)).filter(F.col("associada") == 1)
    sums = rows.groupBy("segmento", "ano").agg(*yearly(rows))
    return sums.select(
        "segmento",
        "ano",
        *[c.alias(n) for n, c in published(specs, net=False, digits=2).items()],
    )


def _metric_names(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    def labels(s: SegmentSpec) -> list[Category]:
        texts = (s.income_label, s.expense_label, s.result_label)
        return [Category(m, t, i) for i, (m, t) in enumerate(zip(METRICS, texts), 1)]

    return dimension(inputs.spark, specs, labels)


def by_metric(inputs: Inputs, specs: Sequence[SegmentSpec], table: DataFrame) -> DataFrame:
    """A yearly table turned to one row per metric with the two compared years side by side."""
    years = {"ano_ant": is_year(specs, 0), "ano_atu": is_year(specs, 1)}
    rows = transpose(table, METRICS, years, "coluna")
    return (
        rows.join(_metric_names(inputs, specs), ["segmento", "coluna"])
        .select("segmento", "ordem", F.col("rotulo").alias("tipo"), "ano_ant", "ano_atu")
    )


def finance_modality(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Operators of the finance modality: the three metrics in the two compared years."""
    ledger = inputs.ledger(specs, _fin_years(specs))
    ledger = ledger.filter(F.col("modalidade") == pick(specs, lambda s: s.finance_modality))
    rows = yearly_rows(ledger, specs)
    sums = rows.groupBy("segmento", "ano").agg(*yearly(rows))
    table = sums.select(
        "segmento",
        "ano",
        *[c.alias(n) for n, c in published(specs, net=True, digits=1).items()],
    )
    return by_metric(inputs, specs, table).orderBy("segmento", "ordem")


def finance_total(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """The whole segment: the three metrics in the two compared years."""
    table = finance_year(inputs, specs, _fin_years(specs))
    return by_metric(inputs, specs, table).orderBy("segmento", "ordem")


def finance_var(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Members' metrics in the two years and their change, taken from the rounded figures."""
    table = by_metric(inputs, specs, finance_members(inputs, specs))
    change = percent_change(F.col("ano_atu"), F.col("ano_ant"))
    return table.select("segmento", "tipo", "ano_ant", "ano_atu", change.alias("var"))


def finance_var_ordered(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """``finance_var`` in axis order."""
    table = by_metric(inputs, specs, finance_members(inputs, specs))
    change = percent_change(F.col("ano_atu"), F.col("ano_ant"))
    return table.withColumn("var", change).orderBy("segmento", "ordem")


def _two_years(specs: Sequence[SegmentSpec], names: Sequence[str]) -> list[Column]:
    """Each named yearly column spread to <name>_ant and <name>_atu."""
    return [
        F.max(F.when(is_year(specs, i), F.col(n))).alias(f"{n}_{suffix}")
        for n in names
        for i, suffix in enumerate(("ant", "atu"))
    ]


def _growth(name: str) -> Column:
    return percent_change(F.col(f"{name}_atu"), F.col(f"{name}_ant"))


def finance_cells(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Net income and expense of the later year."""
    income, expense, _ = METRICS
    return (
        finance_compare(inputs, specs)
        .filter(is_year(specs, 1))
        .select(
            "segmento", F.col(income).alias("fat_total"), F.col(expense).alias("desp_total")
        )
    )


def finance_growth(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Growth of net income and expense between the two years, from the rounded figures."""
    income, expense, _ = METRICS
    table = finance_year(inputs, specs, _fin_years(specs))
    cells = table.groupBy("segmento").agg(*_two_years(specs, (income, expense)))
    return cells.select(
        "segmento",
        _growth(income).alias("fat_total_cres"),
        _growth(expense).alias("desp_total_cres"),
    )


def finance_var_cells(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """The changes of ``finance_var`` as one row per segment."""
    table = finance_members(inputs, specs)
    cells = table.groupBy("segmento").agg(*_two_years(specs, METRICS))
    return cells.select(
        "segmento", *[_growth(m).alias(f"fat_var_{i}") for i, m in enumerate(METRICS, 1)]
    )


def finance_indicators(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """One row per segment with every financial headline, from one pass over the ledger."""
    income, expense, _ = METRICS
    rows = _rows(inputs, specs, _fin_years(specs), by_operator=True).filter(is_fin_year(specs))
    rows = flag_members(rows, inputs.members(specs))
    is_member = F.col("associada") == 1
    sums = rows.groupBy("segmento", "ano").agg(
        *yearly(rows),
        *yearly(rows, is_member, "assoc_"),
        F.max(is_member).alias("has_member"),
    )
    market = published(specs, net=True, digits=1)
    own = {
        n: F.when(F.col("has_member"), c)
        for n, c in published(specs, net=False, digits=2, prefix="assoc_").items()
    }
    table = sums.select(
        "segmento", "ano", *[c.alias(n) for n, c in (market | own).items()]
    )
    cells = table.groupBy("segmento").agg(*_two_years(specs, [*market, *own]))
    return cells.select(
        "segmento",
        F.col(f"{income}_atu").alias("fat_total"),
        _growth(income).alias("fat_total_cres"),
        F.col(f"{expense}_atu").alias("desp_total"),
        _growth(expense).alias("desp_total_cres"),
        *[_growth(f"assoc_{m}").alias(f"fat_var_{i}") for i, m in enumerate(METRICS, 1)],
    )
