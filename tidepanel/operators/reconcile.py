"""Compare two tables that should hold the same rows.

Equal rows are counted by grouping both tables together over all common
columns. Grouping treats nulls as equal, merges copies before the shuffle, and
spreads rows by their whole content, so neither nulls nor repeated rows can
gather in one task as they would in an anti join. A row is grouped as one value:
grouped by single columns, tables that are already spread by some of them would
not be shuffled again, and one task would hold the groups of both tables and of
all that made them at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import pinned, small


def row_balance(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each distinct row of the common columns with its count in either table."""
    common = [c for c in (columns or left.columns) if c in right.columns]

    def tagged(df: DataFrame, l: int, r: int) -> DataFrame:
        return df.select(*common, F.lit(l).cast("bigint").alias("__l"), F.lit(r).cast("bigint").alias("__r"))

    both = tagged(left, 1, 0).unionByName(tagged(right, 0, 1))
    counts = both.groupBy(F.struct(*common).alias("__row")).agg(F.sum("__l").alias("n_left"), F.sum("__r").alias("n_right"))
    return counts.select("__row.*", "n_left", "n_right")


def rows_only_in_left(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` without an equal row in ``right``, with their number of copies."""
    return row_balance(left, right, columns).where((F.col("n_left") > 0) & (F.col("n_right") == 0)).drop("n_right")


def reconcile_anti(left: DataFrame, right: DataFrame, period: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per month, the rows each side has that the other has not; all months appear."""
    balance = row_balance(left, right, columns)
    return balance.groupBy(period).agg(
        F.sum(F.when(F.col("n_right") == 0, F.col("n_left")).otherwise(F.lit(0))).alias("only_left"),
        F.sum(F.when(F.col("n_left") == 0, F.col("n_right")).otherwise(F.lit(0))).alias("only_right"),
    )


def row_hash(columns: Sequence[str], salt: int = 0) -> Column:
    """64 bits of a row's values, and of which of them are null: a plain hash passes over nulls."""
    which = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(salt), which, *[F.col(c) for c in columns])


def signatures(df: DataFrame, columns: Sequence[str], period: str, buckets: int) -> DataFrame:
    """What tells the rows of a (month, bucket) apart from other rows, in any order and with their copies: count, sums and xor of hashes.

    A few numbers per month and bucket, added up by each task before the shuffle.
    """
    first, second = row_hash(columns), row_hash(columns, 1)
    hashed = df.select(F.col(period).alias("period"), first.alias("h"), second.alias("g")).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    low = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
    return hashed.groupBy("period", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("h", 32)).alias("high"), F.sum(low).alias("low"), F.bit_xor("g").alias("mixed")
    )


def differing_buckets(left: DataFrame, right: DataFrame, period: str, columns: Sequence[str] | None = None, buckets: int = 1024) -> DataFrame:
    """(period, bucket) whose rows are not the same on both sides; written once."""
    common = [c for c in (columns or left.columns) if c in right.columns]
    a, b = (signatures(df, common, period, buckets) for df in (left, right))
    told = ["n", "high", "low", "mixed"]
    both = a.select("period", "bucket", F.struct(*told).alias("sign"), F.lit(1).alias("side")).unionByName(
        b.select("period", "bucket", F.struct(*told).alias("sign"), F.lit(2).alias("side"))
    )
    differs = (F.count(F.lit(1)) < 2) | (F.min("sign") != F.max("sign"))
    return pinned(both.groupBy("period", "bucket").agg(differs.alias("differs")).where("differs").select("period", "bucket"))


def reconcile_by_hash(left: DataFrame, right: DataFrame, period: str, columns: Sequence[str] | None = None, buckets: int = 1024) -> DataFrame:
    """:func:`reconcile_anti` for tables that are nearly the same.

    Hashes of whole months and buckets are compared first. Rows are only moved
    and compared, by value, where these differ: two equal tables shuffle a few
    numbers per bucket, whatever their size. Equal rows have equal hashes, so a
    bucket told to be different may turn out the same, and a bucket with other
    rows goes unseen with odds of 2 to the power -128.
    """
    common = [c for c in (columns or left.columns) if c in right.columns]
    buckets_ = differing_buckets(left, right, period, common, buckets)
    months = left.select(period).unionByName(right.select(period)).distinct()
    few = small(buckets_.toDF("__period", "__bucket"))

    def suspect(df: DataFrame) -> DataFrame:
        met = F.col(period).eqNullSafe(F.col("__period")) & (F.pmod(row_hash(common), F.lit(buckets)) == F.col("__bucket"))
        return df.join(few, met, "left_semi")

    found = reconcile_anti(suspect(left), suspect(right), period, common).withColumnRenamed(period, "__found")
    zero = F.lit(0).cast("bigint")
    return months.join(found, F.col(period).eqNullSafe(F.col("__found")), "left").select(
        period, F.coalesce("only_left", zero).alias("only_left"), F.coalesce("only_right", zero).alias("only_right")
    )


def compare_types(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """Columns whose type differs, or that one side lacks."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return [(c, a.get(c), b.get(c)) for c in dict.fromkeys([*a, *b]) if a.get(c) != b.get(c)]


def compare_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with their count on either side."""
    return row_balance(left, right, [column])


def reconcile_types(df: DataFrame, like: DataFrame, text_columns: Sequence[str] = ()) -> DataFrame:
    """Cast to the types of ``like``; empty text becomes null in the named columns."""
    types = dict(like.dtypes)
    out = []
    for c in df.columns:
        column = F.nullif(F.col(c), F.lit("")) if c in text_columns else F.col(c)
        out.append(column.cast(types[c]).alias(c) if c in types else column.alias(c))
    return df.select(*out)
