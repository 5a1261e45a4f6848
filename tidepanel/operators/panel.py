"""Panels: one row per key and period, looked at over the months before it.

Contract: (key, period) is unique, as in any snapshot table. So a key has at
most as many rows as there are months, however skewed the finer data was, and
windows by key stay small. ``monthly`` brings finer data to this grain with
map-side combined aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import safe_div
from tidepanel.functions.periods import month_index, period_of_index, periods_needed

# Suffixes of the feature names.
MAX_SUFFIX = "__MAX"
MIN_SUFFIX = "__MIN"
GROWTH_POLY_SUFFIX = "__CREC_POLI"
GROWTH_FINDIFF_SUFFIX = "__CREC_DIFINI"
ACCEL_POLY_SUFFIX = "__ACEL_POLI"
ACCEL_FINDIFF_SUFFIX = "__ACEL_DIFINI"
# The category of the polynomial trend is named after the acceleration column.
CATEGORY_POLY_SUFFIX = "__ACEL_POLI__CAT_POLI"
CATEGORY_FINDIFF_SUFFIX = "__CREC_DIFINI__CAT_DIFINI"
RELATIVE_SUFFIX = "__ANDREU"
SALARY_FLAG = "dependencia_salarial"

# Weights of y0 (oldest) to y3 (current) and the divisor of each trend.
GROWTH_POLY = ((-2, 9, -18, 11), 6)
GROWTH_FINDIFF = ((3, -4, 1, 0), 2)
ACCEL_POLY = ((-1, 4, -5, 2), 1)
ACCEL_FINDIFF = ((2, -5, 4, -1), 1)

BACKWARD = 3
_MI = "__mi"


@dataclass(frozen=True)
class PanelSpec:
    """What to compute for which columns."""

    key: str
    period: str
    features: tuple[str, ...]
    growth_poly: bool = True
    growth_findiff: bool = True
    accel_poly: bool = True
    accel_findiff: bool = True
    trend_relative: bool = True
    max_min: bool = False
    category_findiff: bool = False
    salary: str | None = None
    fill: str = "zero"

    @property
    def needs_history(self) -> bool:
        return any(
            (self.growth_poly, self.growth_findiff, self.accel_poly, self.accel_findiff, self.trend_relative, self.max_min)
        )


def monthly(df: DataFrame, key: str, period: str, measures: Mapping[str, Column]) -> DataFrame:
    """Finer data to one row per key and period."""
    return df.groupBy(key, period).agg(*[c.alias(name) for name, c in measures.items()])


def _q(name: str) -> str:
    """A column name quoted for use in an expression text."""
    return "`" + name.replace("`", "``") + "`"


def _known(text: str) -> str:
    """The value as double, null if it is missing or NaN."""
    return f"nanvl(cast({text} AS double), cast(NULL AS double))"


def panel_lags(
    df: DataFrame, key: str, period: str, features: Sequence[str], periods: Iterable[int] | None = None, fill: str = "zero"
) -> DataFrame:
    """Current rows plus ``<feature>__y0`` (three months ago) to ``<feature>__y3`` (now).

    Only keys with a row in a wanted period appear; months without a row count
    as missing. One shuffle and sort by key serve all periods and lags: each
    lag is a frame of exactly one month on the month count, over all features
    at once.

    Expressions over many features are given as text: building the same trees
    call by call takes the driver longer than running them.
    """
    if periods is not None:
        periods = list(periods)
        df = df.where(F.col(period).isin(periods_needed(periods, BACKWARD)))
    base = df.columns
    by_key = W.partitionBy(key).orderBy(_MI)
    row = F.struct(*[F.col(_q(c)) for c in features])
    back = range(1, BACKWARD + 1)
    df = df.withColumn(_MI, month_index(F.col(period))).select(
        "*", *[F.first(row).over(by_key.rangeBetween(-j, -j)).alias(f"__back{j}") for j in back]
    )
    if periods is not None:
        df = df.where(F.col(period).isin(periods))
    names = [_q(c) for c in base]
    raw = [f"{_known(_q(c))} AS {_q(f'{c}__y{BACKWARD}')}" for c in features]
    raw += [f"{_known(f'__back{j}.{_q(c)}')} AS {_q(f'{c}__y{BACKWARD - j}')}" for c in features for j in back]
    return _filled(df.selectExpr(*names, *raw), names, features, fill)


def _series(c: str) -> list[str]:
    return [_q(f"{c}__y{i}") for i in range(BACKWARD + 1)]


def _filled(df: DataFrame, names: list[str], features: Sequence[str], fill: str) -> DataFrame:
    """Missing months: ``zero``, ``interpolate``, or ``none`` to leave them null.

    Interpolation takes the ends from their neighbour (else 0), and for an inner
    gap the mean of both neighbours, the earlier gap first.
    """
    if fill == "none":
        return df
    if fill == "zero":
        return df.selectExpr(*names, *[f"coalesce({y}, 0D) AS {y}" for c in features for y in _series(c)])
    if fill != "interpolate":
        raise ValueError(f"fill must be 'zero', 'interpolate' or 'none', not {fill!r}")
    ends, second, third = [], [], []
    for c in features:
        y0, y1, y2, y3 = _series(c)
        ends += [f"coalesce({y0}, {y1}, 0D) AS {y0}", y1, y2, f"coalesce({y3}, {y2}, 0D) AS {y3}"]
        second += [y0, f"coalesce({y1}, ({y0} + {y2}) / 2) AS {y1}", y2, y3]
        third += [y0, y1, f"coalesce({y2}, ({y1} + {y3}) / 2) AS {y2}", y3]
    for step in (ends, second, third):
        df = df.selectExpr(*names, *step)
    return df


def _weighted(y: Sequence[str], weights: tuple[tuple[int, ...], int]) -> str:
    factors, divisor = weights
    total = " + ".join(f"({w}D) * {c}" for c, w in zip(y, factors) if w)
    return f"({total}) / {divisor}D" if divisor != 1 else f"({total})"


def _direction(acceleration: str, growth: str) -> str:
    """-1, 0 or 1: the direction both agree on."""
    return f"signum(signum({acceleration}) + signum({growth}))"


def panel_features(df: DataFrame, spec: PanelSpec, periods: Iterable[int] | None = None) -> DataFrame:
    """Current columns of the wanted periods plus their level, growth, acceleration and trend features.

    Growth is a weighted sum of the four values times their range; acceleration
    is one divided by the range, and null for a constant series.
    """
    if not spec.needs_history:
        return df if periods is None else df.where(F.col(spec.period).isin(list(periods)))
    base = [_q(c) for c in df.columns]
    lag_columns = list(dict.fromkeys([*spec.features, *([spec.salary] if spec.salary else [])]))
    lags = panel_lags(df, spec.key, spec.period, lag_columns, periods, spec.fill)

    # Each step names what the next ones use more than once.
    levels, trends, categories = [], [], []
    made: list[str] = []

    def add(step: list[str], name: str, expression: str) -> str:
        step.append(f"{expression} AS {_q(name)}")
        made.append(_q(name))
        return _q(name)

    for c in spec.features:
        y = _series(c)
        hi, lo, width = f"greatest({', '.join(y)})", f"least({', '.join(y)})", _q(f"__width_{c}")
        levels.append(f"{hi} - {lo} AS {width}")
        if spec.max_min:
            add(levels, c + MAX_SUFFIX, hi)
            add(levels, c + MIN_SUFFIX, lo)
        growth, acceleration = {}, {}
        for wanted, kind, weights, suffix in (
            (spec.growth_poly, "poly", GROWTH_POLY, GROWTH_POLY_SUFFIX),
            (spec.growth_findiff, "findiff", GROWTH_FINDIFF, GROWTH_FINDIFF_SUFFIX),
        ):
            if wanted:
                growth[kind] = add(trends, c + suffix, f"{_weighted(y, weights)} * {width}")
        for wanted, kind, weights, suffix in (
            (spec.accel_poly, "poly", ACCEL_POLY, ACCEL_POLY_SUFFIX),
            (spec.accel_findiff, "findiff", ACCEL_FINDIFF, ACCEL_FINDIFF_SUFFIX),
        ):
            if wanted:
                acceleration[kind] = add(trends, c + suffix, f"{_weighted(y, weights)} / nullif({width}, 0D)")
        if "poly" in growth and "poly" in acceleration:
            add(categories, c + CATEGORY_POLY_SUFFIX, _direction(acceleration["poly"], growth["poly"]))
        if spec.category_findiff and "findiff" in growth and "findiff" in acceleration:
            add(categories, c + CATEGORY_FINDIFF_SUFFIX, _direction(acceleration["findiff"], growth["findiff"]))
        if spec.trend_relative:
            # Relative fall against the month before; null if that was 0.
            add(trends, c + RELATIVE_SUFFIX, f"({y[2]} - {y[3]}) / nullif({y[2]}, 0D)")
    if spec.salary:
        add(levels, SALARY_FLAG, f"if({' + '.join(_series(spec.salary))} > 0, 1, 0)")

    return lags.selectExpr("*", *levels).selectExpr("*", *trends).selectExpr("*", *categories).selectExpr(*base, *made)


def without_history(spec: PanelSpec) -> PanelSpec:
    """The same panel with all trend features off."""
    off = dict.fromkeys(("growth_poly", "growth_findiff", "accel_poly", "accel_findiff", "trend_relative", "max_min"), False)
    return replace(spec, **off)


# --- completing a panel -------------------------------------------------------


def count_by_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def incomplete_keys(df: DataFrame, key: str, months: int = BACKWARD + 1) -> DataFrame:
    """Keys with fewer rows than months."""
    return count_by_key(df, key).where(F.col("count") < months).select(key)


def panel_semi_anti(df: DataFrame, key: str, period: str, current: int, months: int = BACKWARD + 1) -> DataFrame:
    """Drop keys that are incomplete and have no current row; keep all rows of the others."""
    kept = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"), F.max(F.col(period) == current).alias("__now"))
        .where(F.col("__now") | (F.col("__n") >= months))
        .select(key)
    )
    return df.join(kept, key, "left_semi")


def panel_gap_fill(df: DataFrame, key: str, period: str, current: int, backward: int = BACKWARD) -> DataFrame:
    """Add a row with only key and period for each earlier month a current key has no row in."""
    here = month_index(F.lit(current))
    earlier = F.transform(F.sequence(here - backward, here - 1), period_of_index)
    wanted = df.where(F.col(period) == current).select(key).distinct().select(key, F.explode(earlier).alias(period))
    have = df.where(F.col(period).isin(periods_needed([current], backward))).select(key, period)
    added = wanted.join(have, [key, period], "left_anti").withColumn(period, F.col(period).cast(df.schema[period].dataType))
    return df.unionByName(added, allowMissingColumns=True)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that are not in ``b``; copies are merged before the join."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def align_columns(left: DataFrame, right: DataFrame, key: str, period: str) -> DataFrame:
    """Put columns of two tables side by side, matched by key and period."""
    return left.join(right, [key, period], "inner")


# --- history ------------------------------------------------------------------

_AGGREGATES = {"avg": F.avg, "max": F.max, "stddev_pop": F.stddev_pop}


def history(
    df: DataFrame,
    key: str,
    period: str,
    value: str,
    measures: Mapping[str, str],
    first: int = -6,
    last: int = -1,
    null_as_zero: bool = False,
    since: int | None = None,
    periods: Iterable[int] | None = None,
) -> DataFrame:
    """Aggregates over earlier months of the same key.

    ``measures`` maps output names to ``avg``, ``max`` or ``stddev_pop``.
    The frame is ``first`` to ``last`` months relative to the row's month; with
    ``since`` it is all months after that fixed period and before the row's.
    """
    if periods is not None:
        periods = list(periods)
        if since is not None:
            # The rows themselves, and what lies between the fixed bound and the newest of them.
            df = df.where((F.col(period) > since) & (F.col(period) < max(periods)) | F.col(period).isin(periods))
        else:
            df = df.where(F.col(period).isin(periods_needed(periods, -first)))
    base = df.columns
    df = df.withColumn(_MI, month_index(F.col(period)))
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if null_as_zero else F.col(value).cast("double")
    if since is None:
        frame = W.partitionBy(key).orderBy(_MI).rangeBetween(first, last)
    else:
        frame = W.partitionBy(key).orderBy(_MI).rangeBetween(W.unboundedPreceding, last)
        v = F.when(F.col(period) > since, v)
    df = df.select(*base, *[_AGGREGATES[how](v).over(frame).alias(name) for name, how in measures.items()])
    return df if periods is None else df.where(F.col(period).isin(periods))


def history_open(df: DataFrame, key: str, period: str, value: str, measures: Mapping[str, str], months: int = 6, **options) -> DataFrame:
    """:func:`history` with both bounds excluded: 6 months back gives the 5 months in between."""
    return history(df, key, period, value, measures, first=-(months - 1), last=-1, **options)


def rescale_features(df: DataFrame, columns: Sequence[str], low: float = -100.0, high: float = 100.0, digits: int = 2, flip: bool = True) -> DataFrame:
    """Linear rescale to ``low..high``, sign turned by default; one pass for all bounds."""
    bounds = df.agg(F.struct(*[f for c in columns for f in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]).alias("b")).scalar()

    def scaled(c: str) -> Column:
        smallest, largest = bounds.getField(f"min_{c}"), bounds.getField(f"max_{c}")
        from_bottom = (largest - F.col(c)) if flip else (F.col(c) - smallest)
        return F.round(safe_div(from_bottom * F.lit(high - low), largest - smallest) + F.lit(low), digits)

    return df.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def standardise_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and sample standard deviation 1."""
    stats = df.agg(F.struct(*[f for c in columns for f in (F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))]).alias("s")).scalar()
    return df.select(
        *[
            safe_div(F.col(c) - stats.getField(f"avg_{c}"), stats.getField(f"sd_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )
