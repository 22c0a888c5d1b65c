"""Results through the raw layouts: facts are written out as the files have them, and read back."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.operators import crosstab
from marketpulse.operators.compare import is_at
from marketpulse.plans import enrolment, finance
from marketpulse.plans.crosstabs import OPERATOR, modality_columns
from marketpulse.sources.files import money_text
from marketpulse.sources.inputs import Inputs, Replaced, Selected
from marketpulse.sources.ledger import read_long, read_wide
from marketpulse.spec import SegmentSpec, all_quarters, snapshots

# A quarter that ``yoy_with_gap`` does without.
GAP_QUARTER = date(1998, 1, 1)
# Every so many operators have an unpublished count in ``share_with_gaps``.
GAP_EVERY = 97


def _period_text() -> Column:
    """``2000-04-01`` -> ``2000 Q2``."""
    return F.concat_ws(" Q", F.year("ano_tri"), F.quarter("ano_tri"))


def long_ledger_text(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """The ledger with a row per account, all cells text."""
    return inputs.ledger(specs).select(
        F.col("registro").alias("Registro"),
        F.col("modalidade").alias("Modalidade"),
        _period_text().alias("Ano"),
        F.col("class_conta").alias("Class. Conta"),
        money_text("saldo_cents").alias("Saldo Final"),
    )


def wide_ledger_text(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """The ledger with a column per account, all cells text, empty where an account is missing."""
    (spec,) = specs
    accounts = [a.conta for a in spec.accounts]
    keys = ["registro", "modalidade", "ano_tri"]
    sums = [
        F.sum(F.when(F.col("class_conta") == a, F.col("saldo_cents"))).alias(a) for a in accounts
    ]
    table = inputs.ledger(specs).groupBy(*keys).agg(*sums)
    cells = [money_text(a).alias(a) for a in accounts]
    return table.select("registro", "modalidade", _period_text().alias("Ano Tri"), *cells)


def result_of_long_layout(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Operating results from a ledger in the long layout."""
    ledger = read_long(long_ledger_text(inputs, specs), specs)
    return finance.operating_result(Replaced(inputs, ledger=ledger), specs)


def result_of_wide_layout(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Operating results from a ledger in the wide layout."""
    ledger = read_wide(wide_ledger_text(inputs, specs), specs)
    return finance.operating_result(Replaced(inputs, ledger=ledger), specs)


def snapshot_text(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Operator by modality at the current quarter, as published: texts, ``-`` for no data, a total."""
    (spec,) = specs
    fact = inputs.enrolment(specs, {*OPERATOR, "modalidade"}, [spec.current])
    table = crosstab.wide(fact, OPERATOR, "modalidade", modality_columns(specs))
    cells = [c for c in table.columns if c not in ("segmento", *OPERATOR)]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in cells]
    return table.select(*OPERATOR, *texts)


def share_of_requests(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Members' share of all lives, from one snapshot that was fetched by two requests.

    Cells and totals are united over the requests; the shares come from the
    totals, as a ``-`` among the cells says nothing about them.
    """
    (spec,) = specs
    table = snapshot_text(inputs, specs)
    odd = F.xxhash64("registro") % 2 == 0
    requests = [table.filter(odd), table.filter(~odd)]
    cells = [crosstab.to_fact(r, "modalidade", spec.segmento, spec.current) for r in requests]
    totals = [crosstab.totals(r, spec.segmento, spec.current) for r in requests]
    facts = {
        frozenset({*OPERATOR, "modalidade"}): crosstab.unite(cells),
        frozenset(OPERATOR): crosstab.unite(totals),
    }
    return enrolment.share_of_total(Replaced(inputs, enrolment=facts), specs)


def share_with_gaps(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Members' share of all lives where some dental operators' counts are not published."""
    fact = inputs.enrolment(specs, {"registro"}, snapshots(specs, "current"))
    fact = fact.filter(is_at(specs, "current"))
    gap = (F.col("segmento") == "ODO") & (F.col("registro").cast("long") % GAP_EVERY == 0)
    fact = fact.withColumn("beneficiarios", F.when(~gap, F.col("beneficiarios")))
    return enrolment.share_by_flag(fact, inputs.members(specs), F.lit(True))


def yoy_with_gap(inputs: Inputs, specs: Sequence[SegmentSpec]) -> DataFrame:
    """Market and member lives where one quarter was never landed: no row for it, no change against it."""
    quarters = {*all_quarters(specs), *[q for s in specs for q in s.anchor_quarters]} - {GAP_QUARTER}
    return enrolment.market_yoy(Selected(inputs, quarters), specs)
