"""Rounding, guarded sums, ratios and number texts as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def round_to(x: Column, digits: int) -> Column:
    """Round half up after scaling, in doubles; the same on every engine that has ``floor``.

    Scaling may round first: 1.115, which is stored just below, becomes 1.12.
    """
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(now: Column, before: Column) -> Column:
    """Relative change of ``now`` against ``before``."""
    return ratio(now, before) - 1


def percent_change(now: Column, before: Column, digits: int = 1) -> Column:
    return round_to(100 * change(now, before), digits)


def scaled(x: Column, unit: Column, digits: int) -> Column:
    return round_to(x.cast("double") / unit, digits)


def sum_where(cond: Column, x: Column) -> Column:
    return F.sum(F.when(cond, x))


def sum_or_zero(x: Column) -> Column:
    """Sum that skips nulls and is 0 over nothing."""
    return F.coalesce(F.sum(x), F.lit(0))


def guarded_sum(x: Column, where: Column | None = None) -> Column:
    """Sum that is null as soon as one of the rows it covers is null."""
    if where is None:
        return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))
    holes = F.count_if(where & x.isNull())
    return F.when(holes == 0, F.sum(F.when(where, x)))


def sum_with_holes(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Rows summed by ``keys``; keys with a missing value among their rows keep a row without value.

    Plain and guarded sums over the result are those over the rows themselves.
    """
    x = F.col(measure)
    sums = df.groupBy(*keys).agg(
        F.sum(x).alias("_sum"), F.count(F.lit(1)).alias("_rows"), F.count(x).alias("_values")
    )
    nothing = F.lit(None).cast(df.schema[measure].dataType)
    total = F.col("_sum").cast(df.schema[measure].dataType)
    values = (
        F.when(F.col("_rows") == F.col("_values"), F.array(total))
        .when(F.col("_values") == 0, F.array(nothing))
        .otherwise(F.array(total, nothing))
    )
    return sums.select(*keys, F.explode(values).alias(measure))


def whole_number(text: Column, thousands: str = "") -> Column:
    """Count in a text cell; null for anything that is not a whole number.

    ``thousands`` is the mark between groups of three digits, if the cells have one.
    """
    if thousands:
        mark = re.escape(thousands)
        grouped = text.rlike(rf"^\s*-?[0-9]{{1,3}}({mark}[0-9]{{3}})+\s*$")
        text = F.when(grouped, F.replace(text, F.lit(thousands), F.lit(""))).otherwise(
            F.when(~text.contains(thousands), text)
        )
    number = text.try_cast("decimal(38,6)")
    return F.when(number == F.floor(number), number).try_cast("long")


def share_of(x: Column, over: WindowSpec) -> Column:
    """x over the total of its window; null if any part of the total is missing."""
    complete = F.count(F.lit(1)).over(over) == F.count(x).over(over)
    return ratio(x, F.when(complete, F.sum(x).over(over)))


def number_text(x: Column) -> Column:
    """At most one decimal, and none when it is zero: 12.5 -> '12.5', 12.0 -> '12'."""
    return F.regexp_replace(x.cast("decimal(18,1)").cast("string"), r"\.0$", "")


def percent_text(x: Column) -> Column:
    return F.concat(number_text(x), F.lit("%"))
