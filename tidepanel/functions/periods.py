"""Periods are integers ``yyyymm``; arithmetic runs on a plain month count."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(period: Column) -> Column:
    """Months since year 0, so that neighbours differ by 1 over a year end."""
    p = period.cast("int")
    return (F.floor(p / 100) * 12 + p % 100).cast("int")


def period_of_index(index: Column) -> Column:
    """Inverse of :func:`month_index`."""
    zero_based = index - 1
    return (F.floor(zero_based / 12) * 100 + zero_based % 12 + 1).cast("int")


def period_of_date(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def shift_period(period: Column, months: int | Column) -> Column:
    """The period ``months`` later (negative: earlier)."""
    return period_of_index(month_index(period) + months)


def month_start(period: Column) -> Column:
    """First day of the month; null if there is no such month."""
    year, month = F.floor(period / 100).cast("int"), (period % 100).cast("int")
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def date_of_number(number: Column) -> Column:
    """Integer ``yyyymmdd`` to a date; null for days that do not exist.

    Checked by arithmetic: parsing text would raise and catch an exception for
    every bad value.
    """
    first, day = month_start(F.floor(number / 100)), (number % 100).cast("int")
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def shift_period_text(period: Column, months: int) -> Column:
    """As :func:`shift_period`, but through a date and returned as text."""
    return F.date_format(F.add_months(month_start(period), months), "yyyyMM")


def backward_months(period: Column, quantity: int) -> Column:
    """Array of the ``quantity`` months before the period and itself, ascending."""
    here = month_index(period)
    return F.transform(F.sequence(here - quantity, here), period_of_index)


def backward_month_list(period: int, quantity: int) -> list[int]:
    """:func:`backward_months` for a known period, for use in scan filters."""
    here = period // 100 * 12 + period % 100 - 1
    return [m // 12 * 100 + m % 12 + 1 for m in range(here - quantity, here + 1)]


def periods_needed(periods: Iterable[int], quantity: int) -> list[int]:
    """All months that any of the periods looks at, each once."""
    return sorted({m for p in periods for m in backward_month_list(p, quantity)})


def days_to_snapshot(period: Column, date: Column) -> Column:
    """Days from an integer date ``yyyymmdd`` to the first day after the snapshot month.

    Missing and impossible dates give null.
    """
    return F.datediff(F.add_months(month_start(period), 1), date_of_number(date))


def date_text(period: Column, day: str = "01") -> Column:
    """``yyyymm`` to text ``yyyy-mm-dd``."""
    text = period.cast("string")
    return F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-" + day))


def split_periods(text: Column) -> Column:
    """Comma list to array of int; blanks around the commas are ignored."""
    return F.split(F.trim(text), r"\s*,\s*").cast("array<int>")


def join_periods(periods: Column, separator: str = ", ") -> Column:
    return F.array_join(periods.cast("array<string>"), separator)


def elapsed(start: Column, end: Column, unit: str = "minutes") -> Column:
    """Fractional minutes or seconds between two timestamps."""
    per_unit = {"seconds": 1_000_000, "minutes": 60_000_000}[unit]
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(per_unit))
