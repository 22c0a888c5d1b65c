"""Crosstabs with margins, and the way back from a crosstab to a long fact."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import sum_where, whole_number
from marketpulse.functions.periods import QUARTER_ENDS, is_month_of, quarter_of, quarter_of_label

# Names of the margins of a published crosstab.
MARGIN_ROW = "TOTAL"
MARGIN_COLUMN = "total"

MEASURE = "beneficiarios"
ROW_KEYS = ("competencia", "registro", "operadora")


def with_margins(fact: DataFrame, linha: str, coluna: str) -> DataFrame:
    """Long crosstab: cells, row totals, column totals and the grand total of each segment.

    The rows are summed to cells first, so the fourfold expansion of the
    grouping sets runs over cells and not over the fact.
    """
    by = ["segmento", linha, coluna]
    cells = fact.groupBy(*by).agg(F.sum(MEASURE).alias(MEASURE))
    sets = [by, ["segmento", linha], ["segmento", coluna], ["segmento"]]
    margins = cells.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]
    ).agg(
        F.sum(MEASURE).alias(MEASURE),
        F.grouping(linha).alias("_row"),
        F.grouping(coluna).alias("_col"),
    )
    return margins.select(
        "segmento",
        F.when(F.col("_row") == 1, MARGIN_ROW).otherwise(F.col(linha).cast("string")).alias(linha),
        F.when(F.col("_col") == 1, MARGIN_COLUMN)
        .otherwise(F.col(coluna).cast("string"))
        .alias(coluna),
        MEASURE,
    )


def wide(
    fact: DataFrame, linha: Sequence[str], coluna: str, columns: Sequence[tuple[object, str]]
) -> DataFrame:
    """Wide crosstab: one column per (value, name) of ``coluna`` and a ``total`` over all values.

    The values are known, so it is one aggregation with partial sums.
    """
    cells = [
        sum_where(F.col(coluna) == F.lit(v), F.col(MEASURE)).alias(name) for v, name in columns
    ]
    return fact.groupBy("segmento", *linha).agg(*cells, F.sum(MEASURE).alias(MARGIN_COLUMN))


def add_margin_row(table: DataFrame, linha: str) -> DataFrame:
    """Append the TOTAL row of each segment to a wide crosstab."""
    keys = {"segmento", linha}
    sums = [F.sum(c).alias(c) for c in table.columns if c not in keys]
    total = table.groupBy("segmento").agg(*sums).withColumn(linha, F.lit(MARGIN_ROW))
    return table.withColumn(linha, F.col(linha).cast("string")).unionByName(total)


def strip_margins(table: DataFrame) -> DataFrame:
    """Drop the TOTAL rows and the total column of a text crosstab."""
    for key in ROW_KEYS:
        if key in table.columns:
            table = table.filter(~F.col(key).eqNullSafe(F.lit(MARGIN_ROW)))
    return table.drop(MARGIN_COLUMN)


def union_extracts(extracts: Sequence[DataFrame]) -> DataFrame:
    """One frame of several extracts; a column that an extract lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), extracts)


def unite(facts: Sequence[DataFrame]) -> DataFrame:
    """One fact of several requests. A cell that two of them give is an error, not a choice."""
    union = union_extracts(facts)
    keys = [c for c in union.columns if c != MEASURE]
    cells = union.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(MEASURE).alias(MEASURE))
    where = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])
    twice = F.raise_error(F.concat(F.lit("a cell is given twice: "), where)).cast("long")
    return cells.select(*keys, F.when(F.col("_n") > 1, twice).otherwise(F.col(MEASURE)).alias(MEASURE))


def totals(
    table: DataFrame, segmento: str, competencia: date, thousands: str = ""
) -> DataFrame | None:
    """The published total of each operator of a snapshot, which no missing cell voids."""
    keys = [c for c in ("registro", "operadora") if c in table.columns]
    if not keys or MARGIN_COLUMN not in table.columns:
        return None
    value = whole_number(F.col(MARGIN_COLUMN), thousands).alias(MEASURE)
    rows = table
    for key in keys:
        rows = rows.filter(~F.col(key).eqNullSafe(F.lit(MARGIN_ROW)))
    return rows.select(
        F.lit(segmento).alias("segmento"), *keys, F.lit(competencia).alias("competencia"), value
    )


def to_fact(
    table: DataFrame,
    coluna: str,
    segmento: str | None = None,
    competencia: date | None = None,
    keep_missing: bool = True,
    months: Collection[int] = QUARTER_ENDS,
    thousands: str = "",
) -> DataFrame:
    """Text crosstab to long fact.

    ``coluna`` is the dimension spread over the columns; ``competencia`` the
    quarter of a snapshot that carries no period of its own. Periods of other
    ``months`` are left out. Cells that are no whole number become null;
    ``keep_missing=False`` drops them. The periods of columns are known when
    the header is, so no label is parsed per row.
    """
    table = strip_margins(table)
    if segmento is not None:
        table = table.withColumn("segmento", F.lit(segmento))
    keys = [c for c in ("segmento", *ROW_KEYS, "modalidade", "regiao") if c in table.columns]
    cells: list[tuple[str, object]] = [(c, c) for c in table.columns if c not in keys]
    if coluna == "competencia":
        dated = [(c, quarter_of_label(c, months)) for c, _ in cells]
        cells = [(c, q) for c, q in dated if q is not None]
    elif competencia is not None:
        table = table.withColumn("competencia", F.lit(competencia))
        keys.append("competencia")
    else:
        label = F.col("competencia")
        table = table.filter(is_month_of(label, months)).withColumn("competencia", quarter_of(label))
    rows = [
        F.struct(F.lit(value).alias(coluna), whole_number(F.col(c), thousands).alias(MEASURE))
        for c, value in cells
    ]
    if not rows:
        kind = "date" if coluna == "competencia" else "string"
        nothing = {coluna: F.lit(None).cast(kind), MEASURE: F.lit(None).cast("long")}
        return table.select(*keys, *[x.alias(n) for n, x in nothing.items()]).limit(0)
    fact = table.select(*keys, F.inline(F.array(*rows)))
    return fact if keep_missing else fact.filter(F.col(MEASURE).isNotNull())
