"""Segment parameters: everything that differs between the two markets.

A job takes a tuple of specs and computes all of them in one pass over the
long facts; ``pick`` turns a per-segment parameter into a column expression
that Catalyst folds when the segments agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    """One value of a small dimension, with its display name and axis position."""

    key: str
    label: str
    ordem: int
    codigo: int | None = None

    @property
    def column(self) -> str:
        return re.sub(r"\W+", "_", self.key.lower())


@dataclass(frozen=True)
class Account:
    """A ledger account, the role it plays and its sign in the operating result."""

    papel: str
    conta: str
    sinal: int


@dataclass(frozen=True)
class SegmentSpec:
    segmento: str
    member_id: str
    first_quarter: date
    last_quarter: date
    anchor_year: int
    current: date
    prior: date
    fin_years: tuple[int, int]
    yoy_after_year: int
    region_base_year: int
    lives_unit: float
    money_unit: float
    headline: Category
    finance_modality: str | None
    modalities: tuple[Category, ...]
    regions: tuple[Category, ...]
    accounts: tuple[Account, ...]
    missing_account_is_zero: bool
    share_of_headline: bool
    income_label: str = "Receitas de Contraprestações"
    expense_label: str = "Despesa Assistencial"
    result_label: str = "Resultado Operacional"

    def __post_init__(self) -> None:
        for name in ("first_quarter", "last_quarter", "current", "prior"):
            d = getattr(self, name)
            if d.day != 1 or d.month not in (1, 4, 7, 10):
                raise ValueError(f"{name}={d} is not the first day of a quarter")
        if self.prior != self.current.replace(year=self.current.year - 1):
            raise ValueError("prior must be the same quarter one year before current")
        if not self.first_quarter <= self.prior < self.current <= self.last_quarter:
            raise ValueError("compared quarters lie outside the requested range")
        if self.fin_years[0] >= self.fin_years[1]:
            raise ValueError("fin_years must ascend")

    @property
    def quarters(self) -> tuple[date, ...]:
        """Every requested quarter, without gaps."""
        return quarter_range(self.first_quarter, self.last_quarter)

    @property
    def anchor_quarters(self) -> tuple[date, ...]:
        return tuple(date(self.anchor_year, m, 1) for m in (1, 4, 7, 10))

    @property
    def money_cents(self) -> float:
        """Divisor that takes integer cents to the reporting unit."""
        return 100.0 * self.money_unit

    def account(self, papel: str) -> Account | None:
        return next((a for a in self.accounts if a.papel == papel), None)


def quarter_range(first: date, last: date) -> tuple[date, ...]:
    n = (last.year - first.year) * 4 + (last.month - first.month) // 3
    start = first.year * 4 + (first.month - 1) // 3
    return tuple(date(i // 4, i % 4 * 3 + 1, 1) for i in range(start, start + n + 1))


def later(quarter: date, quarters: int) -> date:
    """The quarter so many quarters later (or earlier, if negative)."""
    at = quarter.year * 4 + (quarter.month - 1) // 3 + quarters
    return date(at // 4, at % 4 * 3 + 1, 1)


def all_quarters(specs: Iterable[SegmentSpec]) -> tuple[date, ...]:
    return tuple(sorted({q for s in specs for q in s.quarters}))


def snapshots(specs: Iterable[SegmentSpec], *names: str) -> tuple[date, ...]:
    """The distinct dates that the named spec fields take over the segments."""
    return tuple(sorted({getattr(s, n) for s in specs for n in names}))


def pick(specs: Sequence[SegmentSpec], value: Callable[[SegmentSpec], object]) -> Column:
    """``value(spec)`` of the row's own segment, as a column."""
    values = [value(s) for s in specs]
    if not any(isinstance(v, Column) for v in values) and len(set(values)) == 1:
        return F.lit(values[0])
    out: Column | None = None
    for s, v in zip(specs, values):
        is_segment = F.col("segmento") == s.segmento
        out = F.when(is_segment, v) if out is None else out.when(is_segment, v)
    return out


def one(specs: Sequence[SegmentSpec], segmento: str) -> tuple[SegmentSpec, ...]:
    """The named segment alone, for jobs that only one segment has."""
    return tuple(s for s in specs if s.segmento == segmento)


# Dimension keys, display names, axis positions, region codes and
# ledger accounts that the published tables use.

HEADLINE_MED = Category("medicina_de_grupo", "Medicina de Grupo", 5)
HEADLINE_ODO = Category("odontologia_de_grupo", "Odontologia de Grupo", 7)

MODALITIES_MED = (
    Category("filantropia", "Filantropia", 1),
    Category("autogestao", "Autogestão", 2),
    Category("seguradora_especializada_em_saude", "Seguradoras", 3),
    Category("cooperativa_medica", "Cooperativa Médica", 4),
    HEADLINE_MED,
)

MODALITIES_ODO = (
    Category("autogestao", "Autogestão", 1),
    Category("filantropia", "Filantropia", 2),
    Category("cooperativa_medica", "Cooperativa Médica", 3),
    Category("seguradora_especializada_em_saude", "Seguradoras", 4),
    Category("cooperativa_odontologica", "Cooperativa Odontológica", 5),
    Category("medicina_de_grupo", "Medicina de Grupo", 6),
    HEADLINE_ODO,
)

REGIONS_MED = (
    Category("norte", "Norte", 1, 1),
    Category("nordeste", "Nordeste", 3, 2),
    Category("sudeste", "Sudeste", 5, 3),
    Category("sul", "Sul", 4, 4),
    Category("centro_oeste", "Centro-Oeste", 2, 5),
)

REGIONS_ODO = (
    Category("norte", "Norte", 1, 1),
    Category("nordeste", "Nordeste", 4, 2),
    Category("sudeste", "Sudeste", 5, 3),
    Category("sul", "Sul", 3, 4),
    Category("centro_oeste", "Centro-Oeste", 2, 5),
)

UNIDENTIFIED_REGION = "nao_identificado"

ACCOUNTS_MED = (
    Account("receita", "receita_de_contraprestacoes_medica", 1),
    Account("outras_receitas", "outras_receitas_operacionais", 1),
    Account("corresponsabilidade", "contraprestacoes_de_corresponsabilidade_transferida_medica", 1),
    Account("outras_deducoes", "outras_deducoes_medica", 1),
    Account("despesa", "despesa_assistencial_medica", -1),
    Account("despesa_administrativa", "despesa_administrativa", -1),
    Account("despesa_comercializacao", "despesa_de_comercializacao", -1),
    Account("outras_despesas", "outras_despesas_operacionais", -1),
)

ACCOUNTS_ODO = (
    Account("receita", "receita_de_contraprestacoes_odonto", 1),
    Account("corresponsabilidade", "contraprestacoes_de_corresponsabilidade_transferida_odonto", 1),
    Account("outras_deducoes", "outras_deducoes_odonto", 1),
    Account("despesa", "despesa_assistencial_odonto", -1),
)

MED = SegmentSpec(
    segmento="MED",
    member_id="cod_ans",
    first_quarter=date(2015, 1, 1),
    last_quarter=date(2022, 10, 1),
    anchor_year=2015,
    current=date(2022, 4, 1),
    prior=date(2021, 4, 1),
    fin_years=(2020, 2021),
    yoy_after_year=2016,
    region_base_year=2015,
    lives_unit=1e6,
    money_unit=1e9,
    headline=HEADLINE_MED,
    finance_modality="Medicina de Grupo",
    modalities=MODALITIES_MED,
    regions=REGIONS_MED,
    accounts=ACCOUNTS_MED,
    missing_account_is_zero=True,
    share_of_headline=True,
)

ODO = SegmentSpec(
    segmento="ODO",
    member_id="numero_ans",
    first_quarter=date(2015, 1, 1),
    last_quarter=date(2022, 10, 1),
    anchor_year=2015,
    current=date(2022, 1, 1),
    prior=date(2021, 1, 1),
    fin_years=(2020, 2021),
    yoy_after_year=2016,
    region_base_year=2015,
    lives_unit=1e6,
    money_unit=1e9,
    headline=HEADLINE_ODO,
    finance_modality=None,
    modalities=MODALITIES_ODO,
    regions=REGIONS_ODO,
    accounts=ACCOUNTS_ODO,
    missing_account_is_zero=False,
    share_of_headline=False,
    income_label="Receitas de Contraprestações Odonto",
    expense_label="Despesa Assistencial Odonto",
)
