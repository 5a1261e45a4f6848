"""Column choice, cleaning and preparation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _known(df: DataFrame, columns: Iterable[str]) -> list[str]:
    columns = list(columns)
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return columns


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*_known(df, columns))


def filter_period(df: DataFrame, period: str, value: int) -> DataFrame:
    return df.where(F.col(period) == value)


def filter_in_list(df: DataFrame, column: str, values: Iterable, negate: bool = False) -> DataFrame:
    """Keep (or drop) rows whose value is in a short list; for long lists use a semi or anti join."""
    inside = F.col(column).isin(list(values))
    return df.where(~inside if negate else inside)


def filter_band(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows with ``low <= column <= high``; either end may be open."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def empty_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Empty text to null in all text columns, in one projection."""
    chosen = set(_known(df, columns) if columns is not None else df.columns)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} & chosen
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in text else F.col(c) for c in df.columns])


def strip_quotes(df: DataFrame, column: str, quote: str = '"') -> DataFrame:
    return df.withColumn(column, F.replace(F.col(column), F.lit(quote), F.lit("")))


def missing_shares(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: the share of missing values (null, or NaN in numbers) of each column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    names = _known(df, columns) if columns is not None else df.columns

    def missing(c: str):
        gone = F.col(c).isNull()
        return (gone | F.isnan(c)) if c in floats else gone

    return df.agg(*[F.avg(missing(c).cast("double")).alias(c) for c in names])


def sparse_columns(train: DataFrame, threshold: float = 0.2, columns: Iterable[str] | None = None) -> list[str]:
    """Columns with a missing share above the threshold; one pass over the table."""
    shares = missing_shares(train, columns).first().asDict()
    return [c for c, share in shares.items() if share is not None and share > threshold]


def drop_sparse_columns(train: DataFrame, *others: DataFrame, threshold: float = 0.2) -> list[DataFrame]:
    """Drop what is sparse in the train table from all tables alike."""
    gone = sparse_columns(train, threshold)
    return [df.drop(*gone) for df in (train, *others)]


def select_trend_columns(df: DataFrame, avoid: Sequence[str]) -> list[str]:
    """All columns less the avoid list; a name that is no column is an error."""
    banned = set(_known(df, avoid))
    return [c for c in df.columns if c not in banned]


def reorder_column(df: DataFrame, column: str) -> DataFrame:
    """Move one column to the end."""
    return df.select(*[c for c in df.columns if c != column], column)


MAX_LEVELS = 10_000


def check_levels(train: DataFrame, columns: Sequence[str], most: int = MAX_LEVELS) -> None:
    """Level lists are held by the driver and by each split's histogram: more than ``most`` levels are an error, none is dropped."""
    if not columns:
        return
    found = train.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns]).first().asDict()
    too_many = {c: n for c, n in found.items() if n > most}
    if too_many:
        raise ValueError(f"more than {most} levels: {too_many}")


def categorical_encoder(train: DataFrame, columns: Sequence[str], suffix: str = "_code") -> PipelineModel:
    """Level codes in alphabetic order, learnt from the train table; unseen levels get one more code."""
    from pyspark.ml import Pipeline

    _known(train, columns)
    check_levels(train, columns)
    indexers = [
        StringIndexer(inputCol=c, outputCol=c + suffix, handleInvalid="keep", stringOrderType="alphabetAsc") for c in columns
    ]
    return Pipeline(stages=indexers).fit(train)


def assemble_pool(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector and label."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return assembler.transform(df).select(*keep, "features", F.col(label).cast("double").alias("label"))
