"""From raw snapshot rows to a table for learning, in one plan.

Order: drop unused columns, derive the present-month features, bin the age,
add the trends of all remaining columns, label, drop what must not be learnt.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.columns import bin_age, target_test, target_train
from tidepanel.functions.derived import add_present_features
from tidepanel.functions.periods import days_to_snapshot, periods_needed
from tidepanel.operators.clean import drop_columns, select_trend_columns
from tidepanel.operators.panel import BACKWARD, PanelSpec, panel_features
from tidepanel.sources import schema as S
from tidepanel.sources.readers import scan_master
from tidepanel.sources.writers import write_by_period


@dataclass(frozen=True)
class DatasetSpec:
    """Column roles and switches; the defaults are those of the bank snapshot."""

    key: str = S.KEY
    period: str = S.PERIOD
    label: str = S.LABEL
    age: str | None = "cliente_edad"
    salary: str | None = "tplan_sueldo"
    unused: tuple[str, ...] = S.UNUSED_COLUMNS
    no_trend: tuple[str, ...] = S.NO_TREND_COLUMNS
    drop_last: tuple[str, ...] = ()
    derived: bool = False
    growth_poly: bool = True
    growth_findiff: bool = True
    accel_poly: bool = True
    accel_findiff: bool = True
    trend_relative: bool = True
    max_min: bool = False


def load_dataset(df: DataFrame, periods: Iterable[int] | None = None, spec: DatasetSpec = DatasetSpec()) -> DataFrame:
    """Rows of the periods (None: of all) with all features; earlier months are read only if a trend needs them."""
    periods = None if periods is None else list(periods)
    flags = {n: getattr(spec, n) for n in ("growth_poly", "growth_findiff", "accel_poly", "accel_findiff", "trend_relative", "max_min")}
    if periods is not None:
        months = periods_needed(periods, BACKWARD) if any(flags.values()) else periods
        df = df.where(F.col(spec.period).isin(months))
    rows = drop_columns(df, spec.unused)
    if spec.derived:
        rows = add_present_features(rows)
    if spec.age:
        # Binned after the derived ratios, which divide by the age itself.
        rows = rows.withColumn(spec.age, bin_age(F.col(spec.age)))
    panel = PanelSpec(spec.key, spec.period, tuple(select_trend_columns(rows, spec.no_trend)), salary=spec.salary, **flags)
    return drop_columns(panel_features(rows, panel, periods), spec.drop_last)


def master_to_months(
    spark: SparkSession, source: str, target: str, schema: T.StructType, dates: Sequence[str] = S.DATE_COLUMNS, period: str = S.PERIOD
) -> None:
    """The master file to monthly folders, with the listed integer dates as days before the end of the snapshot month."""
    rows = scan_master(spark, source, schema)
    write_by_period(rows.withColumns({c: days_to_snapshot(F.col(period), F.col(c)) for c in dates}), target, period)


def labelled_for_training(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """``target`` in place of the class: any kind of leaving counts."""
    return df.withColumn("target", target_train(F.col(label))).drop(label)


def labelled_for_testing(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """``target`` in place of the class: only leaving in two months counts."""
    return df.withColumn("target", target_test(F.col(label))).drop(label)
