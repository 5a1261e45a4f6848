"""Exploratory summaries: schema, missing values, classes, quantiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators.clean import missing_shares
from tidepanel.operators.running import running_totals
from tidepanel.session import pinned, small


def class_distribution(df: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """Share of each class in percent of this table's rows; the table is read once."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # A window over one row per class.
    total = F.sum("n").over(W.partitionBy())
    return counts.select(label, "n", F.round(F.col("n") * F.lit(100.0) / total, digits).alias("percent"))


def class_counts(df: DataFrame, label: str, fold: str | None = None) -> DataFrame:
    """Rows per class, or per fold and class."""
    return df.groupBy(*([fold] if fold else []), label).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence) -> DataFrame:
    """One row per actual class, one count column per predicted class."""
    return df.groupBy(actual).agg(
        *[F.count(F.when(F.col(predicted) == c, F.lit(1))).alias(f"pred_{c}") for c in classes]
    )


def missing_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing share per column, in long form; one pass."""
    shares = missing_shares(df, columns)
    return shares.unpivot([], shares.columns, "column_name", "missing_share")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def profile_schema(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Name, type, rows, smallest and largest value (as text) of each column; one pass."""
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    one_row = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.min(c).cast("string").alias(f"lo_{i}") for i, c in enumerate(names)],
        *[F.max(c).cast("string").alias(f"hi_{i}") for i, c in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(types[c]).alias("column_type"), F.col("__n").alias("n_rows"),
                F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value"),
            )
            for i, c in enumerate(names)
        ]
    )
    return one_row.select(F.inline(rows))


def columns_by_type(df: DataFrame) -> DataFrame:
    """Number of columns of each type, from the schema alone."""
    rows = F.array(*[F.lit(t) for _, t in df.dtypes])
    return df.sparkSession.range(1).select(F.explode(rows).alias("column_type")).groupBy("column_type").agg(F.count(F.lit(1)).alias("n_columns"))


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles per group, exact, for groups of any size.

    ``percentile`` would hold all distinct values of a group in one buffer. Here
    equal values are merged, running counts give each value its positions, and
    only the values at the wanted positions are kept.
    """
    by = list(by)
    # Written once: both the running counts and the group sizes come from it.
    merged = pinned(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    placed = running_totals(merged, [F.col(value).asc()], sums={"__upto": F.col("__n")}, by=by)
    sizes = merged.groupBy(*by).agg(F.sum("__n").alias("__size"))
    if by:
        keys = small(pinned(sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__size")))
        same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
        sized = placed.join(keys, same).drop(*[f"__by_{c}" for c in by])
    else:
        sized = placed.withColumn("__size", sizes.select("__size").scalar())

    def value_at(position):
        """The value whose run of equal rows covers a position (from 0)."""
        return F.max(F.when((F.col("__upto") > position) & (F.col("__upto") - F.col("__n") <= position), F.col(value)))

    parts = []
    for name, q in quantiles.items():
        exact = (F.col("__size") - 1) * F.lit(q)
        parts += [
            value_at(F.floor(exact)).alias(f"__lo_{name}"),
            value_at(F.ceil(exact)).alias(f"__hi_{name}"),
            F.max(exact - F.floor(exact)).alias(f"__w_{name}"),
        ]
    found = sized.groupBy(*by).agg(F.max("__size").alias("n"), *parts)
    return found.select(
        *by, "n",
        *[
            (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__w_{name}")).alias(name)
            for name in quantiles
        ],
    )


def _with_hinges(df: DataFrame, value: str, by: str, reach: float) -> DataFrame:
    """Rows of ``df`` with the hinges and fences of their group."""
    hinges = exact_quantiles(df, value, {"lower": 0.25, "middle": 0.5, "upper": 0.75}, [by])
    step = (F.col("upper") - F.col("lower")) * F.lit(reach)
    fences = hinges.select(
        F.col(by).alias("__by"), "lower", "middle", "upper",
        (F.col("lower") - step).alias("__low"), (F.col("upper") + step).alias("__high"),
    )
    rows = df.select(by, value).where(F.col(value).isNotNull())
    # Few groups are broadcast, so that a group with most rows isn't shuffled to one task.
    fences = small(pinned(fences))
    return rows.join(fences, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def box_stats(df: DataFrame, value: str, by: str, reach: float = 1.5) -> DataFrame:
    """Box plot numbers per group: hinges, median, whisker ends, outliers."""
    inside = F.col(value).between(F.col("__low"), F.col("__high"))
    return (
        _with_hinges(df, value, by, reach)
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max("lower").alias("lower"),
            F.max("middle").alias("middle"),
            F.max("upper").alias("upper"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
        )
    )


def box_outliers(df: DataFrame, value: str, by: str, reach: float = 1.5) -> DataFrame:
    """The rows beyond the whiskers."""
    outside = ~F.col(value).between(F.col("__low"), F.col("__high"))
    return _with_hinges(df, value, by, reach).where(outside).select(by, value)


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "tipo", value: str = "segundos") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)
