"""Both layouts of the financial ledger, brought to one long form in integer cents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.names import clean_names
from marketpulse.spec import SegmentSpec

COLUMNS = ("segmento", "registro", "modalidade", "ano_tri", "class_conta", "saldo_cents")


def cents(amount: Column) -> Column:
    """Money text or number to integer cents; null if it is neither."""
    return (amount.try_cast("decimal(20,2)") * 100).cast("long")


def _quarter(col: Column) -> Column:
    """A date, ``2021 Q3`` or a bare year to the first day of its quarter."""
    text = col.cast("string")
    parts = F.regexp_extract(text, r"^(\d{4})\s*[Qq-]?\s*Q?([1-4])?$", 1), F.regexp_extract(
        text, r"^(\d{4})\s*[Qq-]?\s*Q?([1-4])?$", 2
    )
    tri = F.coalesce(parts[1].try_cast("int"), F.lit(1))
    labelled = F.make_date(parts[0].try_cast("int"), tri * 3 - 2, F.lit(1))
    return F.coalesce(F.trunc(text.try_cast("date"), "quarter"), labelled)


def _present(long: DataFrame) -> DataFrame:
    """The rows, and each position that has no row of an account once, without account and amount."""
    at = ["segmento", "registro", "modalidade", "ano_tri"]
    without = long.filter("class_conta IS NULL").select(*at).distinct()
    nothing = {c: F.lit(None).cast(long.schema[c].dataType) for c in ("class_conta", "saldo_cents")}
    return long.filter("class_conta IS NOT NULL").unionByName(without.withColumns(nothing))


def read_long(raw: DataFrame, specs: Sequence[SegmentSpec], period: str = "ano") -> DataFrame:
    """Long layout: one row per operator, period and account.

    A row belongs to each segment that uses its account. Accounts that none of
    the segments uses are left out, but their position stays in all of them.
    """
    df = clean_names(raw)
    conta = F.col("class_conta")
    owners = [
        F.when(
            conta.isin([a.conta for a in s.accounts]),
            F.struct(F.lit(s.segmento).alias("segmento"), conta.alias("conta")),
        )
        for s in specs
    ]
    nobody = F.array(
        *[F.struct(F.lit(s.segmento).alias("segmento"), F.lit(None).cast("string").alias("conta")) for s in specs]
    )
    found = F.array_compact(F.array(*owners))
    long = df.select(
        F.col("registro").cast("string").alias("registro"),
        F.col("modalidade"),
        _quarter(F.col(period)).alias("ano_tri"),
        F.explode(F.when(F.size(found) > 0, found).otherwise(nobody)).alias("of"),
        cents(F.col("saldo_final")).alias("saldo_cents"),
    )
    return _present(
        long.select(
            F.col("of.segmento").alias("segmento"),
            "registro",
            "modalidade",
            "ano_tri",
            F.col("of.conta").alias("class_conta"),
            "saldo_cents",
        )
    )


def read_wide(raw: DataFrame, specs: Sequence[SegmentSpec], period: str = "ano_tri") -> DataFrame:
    """Wide layout: one column per account. An empty cell is a missing account.

    A position whose cells are all empty keeps a row without account, in each
    segment that has one of the columns.
    """
    df = clean_names(raw)
    modalidade = F.col("modalidade") if "modalidade" in df.columns else F.lit(None)
    parts = []
    for s in specs:
        cells = [
            F.struct(
                F.lit(s.segmento).alias("segmento"),
                F.lit(a.conta).alias("class_conta"),
                cents(F.col(a.conta)).alias("saldo_cents"),
            )
            for a in s.accounts
            if a.conta in df.columns
        ]
        if cells:
            kept = F.filter(F.array(*cells), lambda c: c["saldo_cents"].isNotNull())
            empty = F.struct(
                F.lit(s.segmento).alias("segmento"),
                F.lit(None).cast("string").alias("class_conta"),
                F.lit(None).cast("long").alias("saldo_cents"),
            )
            parts.append(F.when(F.size(kept) > 0, kept).otherwise(F.array(empty)))
    if not parts:
        raise ValueError(f"none of the columns {df.columns} is an account of {[s.segmento for s in specs]}")
    long = df.select(
        F.col("registro").cast("string").alias("registro"),
        modalidade.cast("string").alias("modalidade"),
        _quarter(F.col(period)).alias("ano_tri"),
        F.inline(F.concat(*parts)),
    )
    return long.select(*COLUMNS)


def unite(ledgers: Sequence[DataFrame]) -> DataFrame:
    """One ledger of several files. An account of a position that is given twice is an error.

    Positions without an account, from however many files, stay once.
    """
    rows = reduce(DataFrame.unionByName, ledgers)
    keys = [c for c in COLUMNS if c != "saldo_cents"]
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("saldo_cents").alias("saldo_cents"))
    where = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])
    twice = F.raise_error(F.concat(F.lit("a ledger row is given twice: "), where)).cast("long")
    again = (F.col("_n") > 1) & F.col("class_conta").isNotNull()
    return cells.select(*keys, F.when(again, twice).otherwise(F.col("saldo_cents")).alias("saldo_cents"))
