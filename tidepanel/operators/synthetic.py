"""New rows of a rare class, near the ones it has: a smoothed bootstrap.

A row of the class is drawn by a hash, and each of its numbers is moved by
normal noise made from hashes too. The bandwidth is the usual one for a normal
kernel: it falls with the size of the class and grows with the spread of the
column. The same seed gives the same rows in every run and engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.running import numbered

_DIGITS = 15
_SCALE = float(16**_DIGITS)


def hash_number(text: Column) -> Column:
    """The first 60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("bigint")


def hash_normal(text: Column) -> Column:
    """A standard normal value that depends on the text alone."""
    first, second = ((hash_number(F.concat(text, F.lit(end))).cast("double") + 0.5) / _SCALE for end in ("-a", "-b"))
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2 * math.pi) * second)


def smoothed_bootstrap(
    df: DataFrame, label: str, rare: str, id: str, features: Sequence[str], times: int = 1, seed: int = 1, shrink: float = 1.0
) -> DataFrame:
    """All rows with ``draw`` 0, and ``times`` as many new ones of class ``rare`` as it has, with the number of their draw.

    A new row carries the id and all other columns of the row it was drawn from;
    ``features`` are doubles in all rows. A missing number stays missing; a
    column without spread, and a class of one row, gets no noise. ``shrink``
    scales the noise: 0 is plain drawing with replacement.
    """
    wanted = df.where(F.col(label) == rare)
    sums = wanted.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_samp(F.col(f"`{c}`").cast("double")).alias(f"sd{i}") for i, c in enumerate(features)]).first()
    size, d = sums["n"], len(features)
    as_double = {c: F.col(f"`{c}`").cast("double") for c in features}
    kept = df.withColumns({**as_double, "draw": F.lit(0)})
    if not size or times < 1:
        return kept
    width = [shrink * (sums[f"sd{i}"] or 0.0) * (4.0 / ((d + 2) * size)) ** (1.0 / (d + 4)) for i in range(d)]

    rows = numbered(wanted, [F.col(id).asc()], "__n")
    draws = rows.select(F.col(id).alias("__by"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__draw"))
    text = F.concat_ws("-", F.col("__by").cast("string"), F.col("__draw").cast("string"), F.lit(str(seed)))
    draws = draws.select(text.alias("__text"), "__draw").withColumn("__n", hash_number(F.col("__text")) % size + 1)
    # A row is drawn about as often as any other, so the key is even.
    met = draws.join(rows, "__n")
    moved = {c: as_double[c] + F.lit(w) * hash_normal(F.concat(F.col("__text"), F.lit(f"-{i}"))) for i, (c, w) in enumerate(zip(features, width, strict=True))}
    new = met.withColumns({**moved, "draw": F.col("__draw")})
    return kept.unionByName(new.select(*kept.columns))
