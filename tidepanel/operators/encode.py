"""Category columns as numbers that tell what the label does in them.

A level's mean label would leak a row's own label into its feature. So train
rows are put in a random but fixed order, and a row sees only the rows of its
level before it; new rows see all train rows. Levels that are rare, or new, fall
back to a prior. The running counts are made in blocks: a level that holds most
of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ensemble import shuffle_key
from tidepanel.operators.running import running_totals
from tidepanel.session import small

PRIOR = 0.5


def _statistic(hits: Column, n: Column, prior: float, weight: float) -> Column:
    return (hits + F.lit(prior * weight)) / (n + F.lit(weight))


def ordered_target_statistics(
    train: DataFrame, column: str, label: str, id: str, name: str | None = None, prior: float = PRIOR, weight: float = 1.0, seed: int = 1
) -> DataFrame:
    """``train`` with the mean label of earlier rows of the same level, drawn towards ``prior`` with the weight of ``weight`` rows.

    The order is that of a hash of the id, then the id itself. Rows without a
    label count nowhere, but get a value; rows without a level are a level of their own.
    """
    known = F.col(label).isNotNull().cast("bigint")
    own = F.coalesce(F.col(label).cast("bigint"), F.lit(0).cast("bigint"))
    totals = running_totals(
        train, [shuffle_key(id, seed).asc(), F.col(id).asc()], sums={"__hits": own, "__known": known}, by=[column]
    )
    before = _statistic(F.col("__hits") - own, F.col("__known") - known, prior, weight)
    return totals.withColumn(name or f"{column}__ts", before).drop("__hits", "__known")


def target_totals(train: DataFrame, column: str, label: str) -> DataFrame:
    """(level, hits, n) of the labelled rows; one row per level."""
    known = train.where(F.col(label).isNotNull())
    return known.groupBy(F.col(column).alias("level")).agg(F.sum(F.col(label).cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n"))


def with_target_statistics(rows: DataFrame, totals: DataFrame, column: str, name: str | None = None, prior: float = PRIOR, weight: float = 1.0) -> DataFrame:
    """``rows`` with the mean label of their level in the train table; a level that is not there gets the prior."""
    totals = small(totals.toDF("__level", "__hits", "__n"))
    zero = F.lit(0).cast("bigint")
    met = rows.join(totals, F.col(column).eqNullSafe(F.col("__level")), "left")
    value = _statistic(F.coalesce(F.col("__hits"), zero), F.coalesce(F.col("__n"), zero), prior, weight)
    return met.withColumn(name or f"{column}__ts", value).drop("__level", "__hits", "__n")
