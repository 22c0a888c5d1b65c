"""The jobs' inputs derived from a star schema of orders, as given for tests and benchmarks.

Customers stand for operators, their market segment for the modality, the
supplier's region for the region, line quantities for lives, and line prices
for account balances.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.numeric import sum_with_holes
from marketpulse.sources.inputs import DIMENSIONS, known_quarters
from marketpulse.sources.members import read_members
from marketpulse.spec import (
    ACCOUNTS_MED,
    MED,
    ODO,
    UNIDENTIFIED_REGION,
    Account,
    Category,
    SegmentSpec,
    quarter_range,
)

# The star schema's own dimension values and the test parameters.

AUTOMOBILE = Category("AUTOMOBILE", "Automobile", 1)
BUILDING = Category("BUILDING", "Building", 2)
FURNITURE = Category("FURNITURE", "Furniture", 3)
HOUSEHOLD = Category("HOUSEHOLD", "Household", 4)
MACHINERY = Category("MACHINERY", "Machinery", 5)

MODALITIES = (AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY)

STAR_REGIONS_MED = (
    Category("AFRICA", "Africa", 1, 1),
    Category("AMERICA", "America", 3, 2),
    Category("ASIA", "Asia", 5, 3),
    Category("EUROPE", "Europe", 4, 4),
    Category("MIDDLE EAST", "Middle East", 2, 5),
)

STAR_REGIONS_ODO = (
    Category("AFRICA", "Africa", 1, 1),
    Category("AMERICA", "America", 4, 2),
    Category("ASIA", "Asia", 5, 3),
    Category("EUROPE", "Europe", 3, 4),
    Category("MIDDLE EAST", "Middle East", 2, 5),
)

_PARAMETERS = dict(
    first_quarter=date(1995, 1, 1),
    last_quarter=date(2001, 7, 1),
    anchor_year=1995,
    current=date(2001, 4, 1),
    prior=date(2000, 4, 1),
    fin_years=(1999, 2000),
    yoy_after_year=1996,
    region_base_year=1995,
    lives_unit=1e3,
    money_unit=1e6,
    modalities=MODALITIES,
)

STAR_MED = replace(
    MED, **_PARAMETERS, headline=BUILDING, finance_modality="BUILDING", regions=STAR_REGIONS_MED
)
STAR_ODO = replace(ODO, **_PARAMETERS, headline=HOUSEHOLD, regions=STAR_REGIONS_ODO)
STAR_SPECS = (STAR_MED, STAR_ODO)

# The columns that are read, with their stored types; a given schema spares a
# pass over the files' footers.
TABLES = {
    "lineitem": "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_linestatus string",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# Members: operators with a high balance (medical list) or a low one (dental list).
MEMBER_BALANCE = {"MED": lambda bal: bal >= 7300, "ODO": lambda bal: bal < 1750}

# Header of the operator id in each raw list.
MEMBER_HEADER = {"MED": "Cod. ANS", "ODO": "Número ANS"}

# Account role of each of the 16 classes into which the ledger rows fall.
ACCOUNT_CLASSES = (
    *["receita"] * 7,
    "corresponsabilidade",
    "outras_receitas",
    "outras_deducoes",
    *["despesa"] * 3,
    "despesa_administrativa",
    "despesa_comercializacao",
    "outras_despesas",
)

# Roles whose balances are booked with a negative sign.
NEGATIVE_ROLES = ("corresponsabilidade", "outras_deducoes")


def _segment() -> Column:
    return F.when(F.col("l_linestatus") == "O", "MED").otherwise("ODO")


def _only(specs: Sequence[SegmentSpec]) -> Column:
    """Rows of the wanted segments, as a filter on the stored column."""
    names = {s.segmento for s in specs}
    if names == {"MED"}:
        return F.col("l_linestatus") == "O"
    if names == {"ODO"}:
        return ~F.col("l_linestatus").eqNullSafe(F.lit("O"))
    return F.lit(True)


def _quarter_of_order() -> Column:
    return F.trunc("o_orderdate", "quarter")


def _ranges(quarters: Iterable[date]) -> list[tuple[date, date]]:
    """Adjacent quarters merged to half-open date ranges."""
    out: list[tuple[date, date]] = []
    for q in sorted(set(quarters)):
        end = quarter_range(q, q.replace(year=q.year + 1))[1]
        if out and out[-1][1] == q:
            out[-1] = (out[-1][0], end)
        else:
            out.append((q, end))
    return out


def _ordered_in(quarters: Iterable[date]) -> Column:
    """The quarters as ranges of the stored order date, so that the scan can skip by them."""
    cond: Column | None = None
    for start, end in _ranges(quarters):
        at = F.col("o_orderdate")
        part = (at >= F.lit(start).cast("timestamp_ntz")) & (
            at < F.lit(end).cast("timestamp_ntz")
        )
        cond = part if cond is None else cond | part
    return cond if cond is not None else F.lit(False)


class StarInputs:
    """Inputs built from the star schema's Parquet tables under one directory.

    A request joins only the tables whose dimensions it asks for: each
    dimension table has a unique key and is joined from the left, so leaving it
    out changes no row. No join is hinted; table sizes choose the strategy and
    adaptive execution splits hot keys.
    """

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self._directory = directory.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = f"{self._directory}/{name}.parquet"
            self._tables[name] = self.spark.read.schema(TABLES[name]).parquet(path)
        return self._tables[name]

    def enrolment(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> DataFrame:
        orders = self._table("orders").filter(_ordered_in(quarters))
        lines = self._table("lineitem").filter(_only(specs))
        if {"operadora", "modalidade"} & set(dims):
            customer = self._table("customer")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        # What depends on the order alone is computed once per order, before its lines join.
        of_order = {
            "registro": F.col("o_custkey").cast("string"),
            "operadora": F.col("c_name"),
            "modalidade": F.col("c_mktsegment"),
        }
        orders = orders.select(
            "o_orderkey",
            _quarter_of_order().alias("competencia"),
            *[c.alias(n) for n, c in of_order.items() if n in dims],
        )
        fact = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        own = [d for d in DIMENSIONS if d in dims and d != "regiao"]
        fact = fact.select(
            _segment().alias("segmento"),
            "competencia",
            *own,
            "l_suppkey",
            F.col("l_quantity").cast("long").alias("beneficiarios"),
        )
        if "regiao" not in dims:
            return fact.drop("l_suppkey")
        # Lines are summed before their supplier is looked up, so a supplier with many of them is
        # one row a quarter by then.
        fact = sum_with_holes(fact, ["segmento", "competencia", *own, "l_suppkey"], "beneficiarios")
        fact = fact.join(self._regions(), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        return fact.select(
            "segmento",
            "competencia",
            *own,
            F.coalesce("r_name", F.lit(UNIDENTIFIED_REGION)).alias("regiao"),
            "beneficiarios",
        )

    def held(
        self,
        specs: Sequence[SegmentSpec],
        dims: Collection[str],
        quarters: Collection[date],
        anchored: bool = False,
    ) -> DataFrame:
        """Quarters with orders, for every segment; reads the order dates alone."""
        dates = self._table("orders").filter(_ordered_in(quarters))
        found = dates.agg(F.collect_set(_quarter_of_order()).alias("held"))
        segments = F.array(*[F.lit(s.segmento) for s in specs])
        return known_quarters(found.select(F.explode(segments).alias("segmento"), "held"), specs, anchored)

    def serves(
        self, specs: Sequence[SegmentSpec], dims: Collection[str], quarters: Collection[date]
    ) -> bool:
        return True

    def _regions(self) -> DataFrame:
        """Each supplier with the name of its region."""
        nation, region = self._table("nation"), self._table("region")
        nation = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        supplier = self._table("supplier")
        return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            "s_suppkey", "r_name"
        )

    def raw_members(self, segmento: str) -> DataFrame:
        """A member list as it arrives, with its own headers and a numeric id."""
        customer = self._table("customer")
        return customer.filter(MEMBER_BALANCE[segmento](F.col("c_acctbal"))).select(
            F.col("c_custkey").alias(MEMBER_HEADER[segmento]),
            F.col("c_name").alias("Razão Social"),
        )

    def members(self, specs: Sequence[SegmentSpec]) -> DataFrame:
        lists = [read_members(self.raw_members(s.segmento), s) for s in specs]
        out = lists[0]
        for other in lists[1:]:
            out = out.unionByName(other, allowMissingColumns=True)
        return out

    def ledger(
        self, specs: Sequence[SegmentSpec], years: Collection[int] | None = None
    ) -> DataFrame:
        orders = self._table("orders")
        if years is not None:
            orders = orders.filter(
                _ordered_in(date(y, m, 1) for y in years for m in (1, 4, 7, 10))
            )
        orders = orders.select("o_orderkey", _quarter_of_order().alias("ano_tri"))
        lines = self._table("lineitem").filter(_only(specs))
        rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        # Sums of whole cents by whole numbers; what is then left gets its texts.
        amount = F.round(F.col("l_extendedprice") * 100).cast("long")
        rows = rows.select(
            (F.col("l_linestatus") == "O").alias("medical"),
            "l_suppkey",
            "ano_tri",
            ((F.col("l_orderkey") + F.col("l_linenumber")) % len(ACCOUNT_CLASSES)).alias("number"),
            amount.alias("amount"),
        )
        rows = rows.groupBy("medical", "l_suppkey", "ano_tri", "number").agg(
            F.sum("amount").alias("amount")
        )
        number, amount = F.col("number"), F.col("amount")
        negative = [i for i, r in enumerate(ACCOUNT_CLASSES) if r in NEGATIVE_ROLES]
        modality = F.element_at(
            _texts([m.key for m in MODALITIES]),
            (F.col("l_suppkey") % len(MODALITIES) + 1).cast("int"),
        )
        return rows.select(
            F.when(F.col("medical"), "MED").otherwise("ODO").alias("segmento"),
            F.col("l_suppkey").cast("string").alias("registro"),
            modality.alias("modalidade"),
            "ano_tri",
            _account_name(number).alias("class_conta"),
            F.when(number.isin(negative), -amount).otherwise(amount).alias("saldo_cents"),
        )


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _account_name(number: Column) -> Column:
    """The segment's account of a class; roles that only one segment has keep that name."""

    def names(accounts: Sequence[Account]) -> Column:
        own = {a.papel: a.conta for a in ACCOUNTS_MED} | {a.papel: a.conta for a in accounts}
        return F.element_at(_texts([own[r] for r in ACCOUNT_CLASSES]), (number + 1).cast("int"))

    return F.when(F.col("medical"), names(STAR_MED.accounts)).otherwise(
        names(STAR_ODO.accounts)
    )
