"""Comparisons along time and turning metrics into rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketpulse.functions.numeric import change
from marketpulse.spec import SegmentSpec, pick

QUARTERS_PER_YEAR = 4


def series(*by: str) -> WindowSpec:
    """A quarterly series. Only for aggregates: its rows are quarters, not operators."""
    return Window.partitionBy(*by).orderBy("competencia")


def year_over_year(x: str, over: WindowSpec) -> Column:
    """Change against four rows before, as in a gap-free quarterly series."""
    return change(F.col(x), F.lag(x, QUARTERS_PER_YEAR).over(over))


def since_last_year(x: str, over: WindowSpec) -> Column:
    """Change against the same quarter of the year before; null where the series lacks that quarter.

    In a series without gaps it is ``year_over_year``; gaps only bring the quarter nearer.
    """
    year_ago = F.add_months("competencia", -12)
    rows = range(QUARTERS_PER_YEAR, 0, -1)
    before = [F.when(F.lag("competencia", k).over(over) == year_ago, F.lag(x, k).over(over)) for k in rows]
    return change(F.col(x), F.coalesce(*before))


def is_at(specs: Sequence[SegmentSpec], name: str, column: str = "competencia") -> Column:
    """The row's period is the named date of its segment's spec."""
    return F.col(column) == pick(specs, lambda s: getattr(s, name))


def is_year(specs: Sequence[SegmentSpec], which: int, column: str = "ano") -> Column:
    return F.col(column) == pick(specs, lambda s: s.fin_years[which])


def is_fin_year(specs: Sequence[SegmentSpec], column: str = "ano") -> Column:
    return is_year(specs, 0, column) | is_year(specs, 1, column)


def required(specs: Sequence[SegmentSpec], name: str, value: Column) -> Column:
    """An aggregate of a segment's rows; an error if none of the rows is at the named quarter."""
    text = pick(specs, lambda s: f"MissingPeriod: {s.segmento} has no data for its {name} quarter {getattr(s, name)}")
    none = F.count_if(is_at(specs, name)) == 0
    return F.when(none, F.raise_error(text).cast("double")).otherwise(value)


def transpose(
    df: DataFrame,
    metrics: Sequence[str],
    periods: Mapping[str, Column],
    name: str,
    needed: Callable[[str, Column], Column] = lambda out, value: value,
) -> DataFrame:
    """Metrics to rows, periods to columns: (segmento, <name>, one column per period).

    ``periods`` maps the output column to the condition that selects its rows;
    ``needed`` may wrap each output column's aggregate.
    """
    long = df.unpivot([c for c in df.columns if c not in metrics], list(metrics), name, "_v")
    return long.groupBy("segmento", name).agg(
        *[needed(out, F.max(F.when(cond, F.col("_v")))).alias(out) for out, cond in periods.items()]
    )


def compared_quarters(df: DataFrame, specs: Sequence[SegmentSpec], metrics: Sequence[str], name: str) -> DataFrame:
    """``transpose`` of the prior and the current quarter (``ant``, ``atu``); an error names one without data."""
    periods = {"ant": is_at(specs, "prior"), "atu": is_at(specs, "current")}
    names = {"ant": "prior", "atu": "current"}
    return transpose(df, metrics, periods, name, lambda out, value: required(specs, names[out], value))
