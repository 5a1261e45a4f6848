"""Running totals over a whole table, or over groups of any size.

A window without partition keys, or with a key that holds a large share of the
rows, is computed by a single task. Here the rows are cut into ordered blocks
first: block totals give each block its start value, and only the rest is
summed inside the block. A group of any size is spread over many blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.session import pinned

_BLOCK = "__block"


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Append running sums and maxima in the given order, per group of ``by``.

    ``order_by`` should end in a unique column: then the result does not depend
    on how rows happen to arrive, and rows with one equal value can be split.
    """
    sums, maxima, by = dict(sums or {}), dict(maxima or {}), list(by)
    ranged = df.repartitionByRange(*[F.col(c).asc() for c in by], *order_by).withColumn(_BLOCK, F.spark_partition_id())
    # The sampled block bounds may differ between runs; block totals and rows must see the same ones.
    blocks = pinned(ranged)

    totals = blocks.groupBy(*by, _BLOCK).agg(
        *[F.sum(c).alias(f"__sum_{name}") for name, c in sums.items()],
        *[F.max(c).alias(f"__max_{name}") for name, c in maxima.items()],
    )
    # One row per block and group: as many as there are blocks, plus one for each further group.
    earlier = W.partitionBy(*by).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"__by_{c}") for c in by],
        F.col(_BLOCK).alias("__start_block"),
        *[F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__from_{name}") for name in sums],
        *[F.max(f"__max_{name}").over(earlier).alias(f"__from_{name}") for name in maxima],
    )

    inside = W.partitionBy(*by, _BLOCK).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    local = blocks.select(
        "*",
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{name}") for name, c in sums.items()],
        *[F.max(c).over(inside).alias(f"__in_{name}") for name, c in maxima.items()],
    )
    same = F.col(_BLOCK) == F.col("__start_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return local.join(starts, same, "inner").select(
        *[F.col(f"`{c}`") for c in df.columns if c not in sums and c not in maxima],
        *[(F.col(f"__in_{name}") + F.col(f"__from_{name}")).alias(name) for name in sums],
        *[F.greatest(F.col(f"__in_{name}"), F.col(f"__from_{name}")).alias(name) for name in maxima],
    )


def numbered(df: DataFrame, order_by: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1, per group of ``by``, without gathering a group in one task."""
    return running_totals(df, order_by, sums={name: F.lit(1).cast("bigint")}, by=by)
