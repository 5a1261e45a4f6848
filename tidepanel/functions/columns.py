"""Null-aware arithmetic, recoding and labels."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return c.cast("double")


def no_nan(c: Column) -> Column:
    """NaN to null; infinite values stay."""
    return F.nanvl(_double(c), F.lit(None).cast("double"))


def fill_zero(c: Column) -> Column:
    """Null and NaN to 0; infinite values stay."""
    return F.coalesce(no_nan(c), F.lit(0.0))


def coalesce_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def safe_div(numerator: Column, divisor: Column, ieee: bool = False) -> Column:
    """Quotient; a zero divisor gives null, or with ``ieee`` an infinity or NaN."""
    n, d = _double(numerator), _double(divisor)
    if not ieee:
        return F.try_divide(n, d)
    by_zero = (
        F.when(n.isNull() | d.isNull(), F.lit(None))
        .when((n == 0) | F.isnan(n), F.lit(float("nan")))
        .when(n > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def guarded_ratio(numerator: Column, divisor: Column) -> Column:
    """Quotient, or 0 where the divisor is missing or 0; decided for each row."""
    return F.when(divisor.isNull() | (divisor == 0), F.lit(0.0)).otherwise(F.try_divide(_double(numerator), _double(divisor)))


def row_sum_nullskip(*columns: Column) -> Column:
    """Sum over the columns that have a value; 0 where none has."""
    return reduce(add, (fill_zero(c) for c in columns))


def row_max_nullskip(*columns: Column) -> Column:
    return F.greatest(*(no_nan(c) for c in columns))


def row_min_nullskip(*columns: Column) -> Column:
    return F.least(*(no_nan(c) for c in columns))


def row_mean(*columns: Column) -> Column:
    """Plain mean over columns; null if any is null."""
    return reduce(add, (_double(c) for c in columns)) / F.lit(float(len(columns)))


def null_sum(*columns: Column) -> Column:
    """Sum that is null as soon as one part is null."""
    return reduce(add, (_double(c) for c in columns))


def complement(probability: Column) -> Column:
    return F.lit(1.0) - probability


def sign(c: Column) -> Column:
    return F.signum(_double(c))


def bin_right_closed(c: Column, breaks: list[float]) -> Column:
    """Interval label of ``c`` for ascending inner breaks, each interval closed at the right.

    The outermost intervals are open-ended. ML's ``Bucketizer`` closes intervals
    at the left, so it cannot be used for this.
    """

    def text(b: float) -> str:
        return f"{b:g}"

    labels = [f"(-Inf,{text(breaks[0])}]"]
    labels += [f"({text(low)},{text(high)}]" for low, high in zip(breaks, breaks[1:])]
    label = F.when(c.isNull(), F.lit(None).cast("string"))
    for high, name in zip(breaks, labels):
        label = label.when(c <= high, F.lit(name))
    return label.otherwise(F.lit(f"({text(breaks[-1])}, Inf]"))


# Inner breaks of the age bins.
AGE_BREAKS = [18, 25, 40, 55]


def bin_age(c: Column) -> Column:
    return bin_right_closed(c, AGE_BREAKS)


# Label texts of the ternary class.
CLASS_STAYS = "CONTINUA"
CLASS_LEAVES_IN_1 = "BAJA+1"
CLASS_LEAVES_IN_2 = "BAJA+2"


def target_train(label: Column, stays: str = CLASS_STAYS) -> Column:
    """0 for staying, 1 for either kind of leaving, null for no label."""
    return F.when(label.isNull(), F.lit(None)).when(label == stays, F.lit(0)).otherwise(F.lit(1)).cast("int")


def target_test(label: Column, leaves: str = CLASS_LEAVES_IN_2) -> Column:
    """1 only for leaving in two months, else 0, null for no label."""
    return F.when(label.isNull(), F.lit(None)).when(label == leaves, F.lit(1)).otherwise(F.lit(0)).cast("int")


def format_money(c: Column) -> Column:
    """``$1.234.567``: no decimals, dots between thousands."""
    return F.concat(F.lit("$"), F.translate(F.format_number(_double(c), 0), ",", "."))
