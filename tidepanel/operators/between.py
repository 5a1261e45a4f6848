"""Aggregates over a span of earlier rows whose two bounds come from the row itself.

A window frame has one width for all rows, and a join on a range compares every
row with all rows of its key. Here time is cut into buckets, and buckets are
added up in pairs, pairs of pairs and so on. A span is then its first and last
bucket, of which single rows are looked up, and at most two whole nodes of each
size in between. All joins are on (key, node), so a key with most of the rows is
spread over its buckets, and a row meets a number of nodes that grows with the
logarithm of its span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sums that can be merged; what can be asked for is made of them.
_STATES = {
    "n": lambda v: F.count(v),
    "s": lambda v: F.sum(v),
    "q": lambda v: F.sum(v * v),
    "high": lambda v: F.max(v),
    "low": lambda v: F.min(v),
}
_MERGED = {"n": F.sum, "s": F.sum, "q": F.sum, "high": F.max, "low": F.min}
_MEASURES = {
    "count": (("n",), lambda c: F.coalesce(c["n"], F.lit(0).cast("bigint"))),
    "sum": (("s",), lambda c: c["s"]),
    "avg": (("s", "n"), lambda c: F.try_divide(c["s"], c["n"])),
    "max": (("high",), lambda c: c["high"]),
    "min": (("low",), lambda c: c["low"]),
    "stddev_pop": (("n", "s", "q"), lambda c: F.when(c["n"] > 0, F.sqrt(F.greatest(c["q"] / c["n"] - F.pow(c["s"] / c["n"], 2), F.lit(0.0))))),
}


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """(level, node) of the fewest nodes that cover the buckets from ``first`` up to, not with, ``last``."""

    def of_level(k: Column) -> Column:
        # In units of 2^k: the first node inside, and the end of the last one.
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        left, right = F.call_function("shiftright", first + size - 1, k), F.call_function("shiftright", last, k)
        # At the top all nodes are taken, below only those whose twin lies outside.
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        inside = left < right
        node = lambda at: F.struct(k.cast("int").alias("level"), at.alias("node"))
        top = F.when(inside, F.transform(F.sequence(left, right - 1), node)).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        pair = F.array(F.when(inside & odd(left), node(left)), F.when(inside & odd(right), node(right - 1)))
        return F.when(k == levels - 1, top).otherwise(F.filter(pair, lambda x: x.isNotNull()))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), of_level))


def history_between(
    rows: DataFrame, events: DataFrame, id: Sequence[str], key: str, lower: Column, upper: Column, time: Column, value: Column,
    measures: Mapping[str, str], width: int, levels: int = 16,
) -> DataFrame:
    """``id`` and ``measures`` for each of ``rows``: over the events of its key with lower < time < upper.

    ``lower``, ``upper`` and ``time`` are whole numbers (microseconds, days, months); ``id`` is unique in ``rows``.
    ``measures`` maps output names to count, sum, avg, max, min or stddev_pop. A row with a null bound or key, or a
    span without events, has a count of 0 and nulls. Events without time or key are left out; a missing value is
    not counted. ``width`` is that of a bucket: wide enough that a key has few buckets, narrow enough that a bucket
    has few events. Spans longer than ``width * 2 ** levels`` take several nodes of the largest size.
    """
    unknown = set(measures.values()) - set(_MEASURES)
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}")
    if width < 1 or not 1 <= levels <= 40:
        raise ValueError("width is at least 1 and levels between 1 and 40")
    states = list(dict.fromkeys(s for how in measures.values() for s in _MEASURES[how][0]))
    # Floor division of whole numbers, also of negative ones.
    whole = lambda t: F.call_function("div", t - F.pmod(t, F.lit(width).cast("bigint")), F.lit(width).cast("bigint"))

    known = events.select(F.col(key).alias("__key"), time.cast("bigint").alias("__t"), value.alias("__v")).where(F.col("__key").isNotNull() & F.col("__t").isNotNull())
    known = known.withColumn("__b", whole(F.col("__t")))
    # Each event is in one node of each size; a task adds up its own before the shuffle.
    summed = (
        known.select("__key", "__v", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.call_function("shiftright", F.col("__b"), k))).alias("level", "node"))
        .groupBy("__key", "level", "node")
        .agg(*[_STATES[s](F.col("__v")).alias(s) for s in states])
    )

    spans = rows.select(*id, F.col(key).alias("__key"), (lower.cast("bigint") + 1).alias("__from"), upper.cast("bigint").alias("__to"))
    spans = spans.withColumns({"__first": whole(F.col("__from")), "__last": whole(F.col("__to") - 1)})
    real = F.col("__key").isNotNull() & F.coalesce(F.col("__from") < F.col("__to"), F.lit(False))
    if width > 1:
        inner = _nodes(F.col("__first") + 1, F.col("__last"), levels)
        edges = F.array_distinct(F.array("__first", "__last"))
    else:
        # A bucket is one moment: none is cut by a bound.
        inner, edges = _nodes(F.col("__first"), F.col("__last") + 1, levels), F.array().cast("array<bigint>")
    spans = spans.withColumns({"__inner": F.when(real, inner), "__edges": F.when(real, edges)})

    # An inner explode would first be filtered by its size, with the whole expression once more for every row; the joins drop the nulls.
    at = spans.select(*id, "__key", F.explode_outer("__inner").alias("__n")).select(*id, "__key", F.col("__n.level").alias("level"), F.col("__n.node").alias("node"))
    parts = [at.join(summed, ["__key", "level", "node"]).select(*id, *states)]
    if width > 1:
        cut = spans.select(*id, F.col("__key").alias("__k"), "__from", "__to", F.explode_outer("__edges").alias("__e"))
        inside = (F.col("__k") == F.col("__key")) & (F.col("__e") == F.col("__b")) & (F.col("__t") >= F.col("__from")) & (F.col("__t") < F.col("__to"))
        near = cut.join(known, inside)
        single = {"n": F.when(F.col("__v").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), "s": F.col("__v"), "q": F.col("__v") * F.col("__v"), "high": F.col("__v"), "low": F.col("__v")}
        parts.append(near.select(*id, *[single[s].alias(s) for s in states]))
    # Every row once, so that a span without events is answered too.
    types = dict(parts[0].dtypes)
    merged = rows.select(*id, *[F.lit(None).cast(types[s]).alias(s) for s in states])
    for part in parts:
        merged = merged.unionByName(part.select(*id, *[F.col(s).cast(types[s]).alias(s) for s in states]))
    totals = merged.groupBy(*id).agg(*[_MERGED[s](s).alias(s) for s in states])
    columns = {s: F.col(s) for s in states}
    return totals.select(*id, *[_MEASURES[how][1](columns).alias(name) for name, how in measures.items()])
