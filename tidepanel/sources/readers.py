"""Readers. All take a schema: nothing is inferred, so no file is read twice. A value of another type stops the load."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tsv(spark: SparkSession, schema: T.StructType, header: bool, null_token: str = ""):
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", str(header).lower())
        .option("nullValue", null_token)
        .option("enforceSchema", "false" if header else "true")
        .option("mode", "FAILFAST")
    )


def scan_snapshots(
    spark: SparkSession, path: str, periods: Iterable[int], schema: T.StructType, period: str = "foto_mes"
) -> DataFrame:
    """Monthly TSV folders ``<path>/<period>=<yyyymm>`` of the given months, stacked.

    The filter is on the folder name, so other months are never opened.
    """
    inside = T.StructType([f for f in schema.fields if f.name != period])
    data = _tsv(spark, inside, header=True).option("basePath", path).csv(path)
    return data.withColumn(period, F.col(period).cast("int")).where(F.col(period).isin(list(periods))).select(*schema.fieldNames())


def scan_snapshot_files(spark: SparkSession, pattern: str, periods: Iterable[int], schema: T.StructType) -> DataFrame:
    """Monthly TSV files named by a pattern such as ``/data/{period}_dias.txt``."""
    return _tsv(spark, schema, header=True).csv([pattern.format(period=p) for p in periods])


def scan_master(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The one big TSV with all months."""
    return _tsv(spark, schema, header=True).csv(path)


def read_typed(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Delimited files under a fixed schema; a value of another type stops the load."""
    return _tsv(spark, schema, header=True).csv(path)


def bulk_load_typed(
    spark: SparkSession, path: str | list[str], schema: T.StructType, target: str, period: str = "foto_mes"
) -> DataFrame:
    """Load delimited files into Parquet, one folder per month, and return the table."""
    from tidepanel.sources.writers import write_parquet_by_period

    write_parquet_by_period(read_typed(spark, path, schema), target, period)
    return scan_table_all(spark, target)


def scan_table_all(spark: SparkSession, source: str) -> DataFrame:
    """A Parquet folder, or a catalog table if the name has no slash."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def scan_period_table(spark: SparkSession, source: str, periods: Iterable[int], period: str = "foto_mes") -> DataFrame:
    """The rows of some months; on a month-partitioned table only their folders are read."""
    return scan_table_all(spark, source).where(F.col(period).isin(list(periods)))


def scan_by_class(
    spark: SparkSession, source: str, label_value: str, periods: Iterable[int], label: str = "clase_ternaria", period: str = "foto_mes"
) -> DataFrame:
    return scan_period_table(spark, source, periods, period).where(F.col(label) == label_value)


def scan_predictions(spark: SparkSession, files: Mapping[str, str], schema: T.StructType) -> DataFrame:
    """Prediction files, one per model, as one long table (id, model, prob, class)."""
    id_column = schema.fieldNames()[0]
    parts = [
        spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path).withColumn("model", F.lit(model))
        for model, path in files.items()
    ]
    stacked = reduce(DataFrame.unionByName, parts)
    rest = [c for c in schema.fieldNames()[1:]]
    return stacked.select(F.col(id_column).alias("id"), "model", *rest)


def scan_custom_na(spark: SparkSession, path: str | list[str], schema: T.StructType, null_token: str = "NAN") -> DataFrame:
    """Headerless TSV with its own token for missing values."""
    return _tsv(spark, schema, header=False, null_token=null_token).csv(path)
