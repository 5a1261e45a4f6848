"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import pinned

# A row of a key list takes about 50 bytes on an executor: 100,000 rows are some 5 MB.
BROADCAST_ROWS = 100_000
# Texts go to Python in batches of about this size: by rows alone, long texts would fill executors and workers.
BATCH_BYTES = 8 << 20
_SPARK_BATCH_BYTES = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Ends Arrow batches at ``BATCH_BYTES`` too (a row is never cut); a value set by the caller stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, str(_SPARK_BATCH_BYTES)).rstrip("bB") == str(_SPARK_BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def narrowed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, cannot get in the way. Null text is empty."""
    bound_batches(df.sparkSession)
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written, narrow ``df`` for broadcast if it has at most ``rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same_key(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of two keys in which nulls are equal."""
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & a.eqNullSafe(b)
    return cond


def without(docs: DataFrame, keys: Sequence[Column], dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are not in ``dropped`` (same columns in the same order).

    ``dropped`` is written once; the rows of ``docs`` are only shuffled where it is too long to broadcast.
    """
    dropped = small_side(pinned(dropped.toDF(*[f"__d{i}" for i in range(len(keys))])))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    cond = same_key([F.col(f"__k{i}") for i in range(len(keys))], [F.col(f"__d{i}") for i in range(len(keys))])
    return rows.join(dropped, cond, "left_anti").select("__row.*")
