"""Quarter labels: ``mar/22`` <-> first day of the quarter."""

from __future__ import annotations

import re
from collections.abc import Collection
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations of the period labels, January first.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")

# Fixed value: a period column of an operator crosstab, e.g. mar_15.
PERIOD_COLUMN = r"[a-z]{3}_[0-9]{2}"

# Months that close a quarter; counts of other months are stocks of the same lives.
QUARTER_ENDS = (3, 6, 9, 12)

# Two-digit years from this one on belong to the 20th century.
CENTURY_PIVOT = 69


def closing_month(quarter: Column) -> Column:
    """First day of the last month of the quarter."""
    return F.add_months(quarter, 2)


def label(quarter: Column, sep: str = "/") -> Column:
    """``2022-01-01`` -> ``mar/22``: a quarter is named after its last month."""
    last = closing_month(quarter)
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(last))
    return F.concat(name, F.lit(sep), F.date_format(last, "yy"))


def long_label(quarter: Column) -> Column:
    """``2022-01-01`` -> ``Mar 2022``."""
    last = closing_month(quarter)
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(last))
    return F.initcap(F.concat_ws(" ", name, F.year(last).cast("string")))


def label_of(quarter: date, sep: str = "_") -> str:
    """The label of a known quarter, for column names."""
    return f"{MONTHS[quarter.month + 1]}{sep}{quarter.year % 100:02d}"


def quarter_of_label(text: str, months: Collection[int] = QUARTER_ENDS) -> date | None:
    """``mar_22`` -> its quarter's first day, as a known date; None for other texts and months."""
    found = re.fullmatch(r"([a-z]{3})[/_ ]([0-9]{2})", text.strip().lower())
    if not found or found[1] not in MONTHS or MONTHS.index(found[1]) + 1 not in months:
        return None
    month, yy = MONTHS.index(found[1]) + 1, int(found[2])
    return date(yy + (1900 if yy >= CENTURY_PIVOT else 2000), (month - 1) // 3 * 3 + 1, 1)


def is_month_of(text: Column, months: Collection[int] = QUARTER_ENDS) -> Column:
    """Whether a period label names one of the months."""
    name = F.substring(F.lower(F.trim(text)), 1, 3)
    return name.isin([MONTHS[m - 1] for m in months])


def quarter_of(text: Column) -> Column:
    """``mar/22`` or ``mar_22`` -> ``2022-01-01``; null if the text is no period label."""
    parts = F.split(F.lower(F.trim(text)), "[/_ ]")
    number = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, i)])
    month = F.try_element_at(number, F.try_element_at(parts, F.lit(1)))
    yy = F.try_element_at(parts, F.lit(2)).try_cast("int")
    year = F.when(yy >= CENTURY_PIVOT, yy + 1900).otherwise(yy + 2000)
    return F.trunc(F.make_date(year, month, F.lit(1)), "quarter")
