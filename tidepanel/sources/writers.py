"""Writers. Months are written in one job, whatever their number and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grouped_by_period(df: DataFrame, period: str) -> DataFrame:
    """Rows of a month close together, a big month over several tasks.

    A plain ``repartition(period)`` would put the largest month into one task;
    the rebalance hint lets adaptive execution cut it into files of normal size.
    """
    return df.hint("rebalance", F.col(period))


def write_by_period(df: DataFrame, path: str, period: str = "foto_mes", null_token: str = "") -> None:
    """One TSV folder per month, header included, missing values empty."""
    (
        _grouped_by_period(df, period)
        .write.partitionBy(period)
        .option("sep", "\t")
        .option("header", "true")
        .option("nullValue", null_token)
        .option("emptyValue", "")
        .csv(path)
    )


def write_parquet_by_period(df: DataFrame, path: str, period: str = "foto_mes", mode: str = "errorifexists") -> None:
    _grouped_by_period(df, period).write.mode(mode).partitionBy(period).parquet(path)


def write_id_list(ranked: DataFrame, path: str, id_column: str) -> None:
    """Ids only, as text lines without header or quotes, in the order of the rows."""
    ranked.select(F.col(id_column).cast("string").alias("value")).write.text(path)
