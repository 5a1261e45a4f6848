"""Several models' scores side by side, folds, and class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import complement, row_mean, no_nan
from tidepanel.operators.running import numbered
from tidepanel.session import pinned, small


def ensemble_full_join(scores: DataFrame, models: Sequence, id: str = "id", model: str = "model", prob: str = "prob", label: str | None = "class") -> DataFrame:
    """One row per id with ``prob_model_<m>`` for each model; null where a model lacks the id.

    ``scores`` is the long table of all models. Grouping by id is one shuffle,
    where a chain of full joins would take one for each model.
    """
    columns = [F.max(F.when(F.col(model) == m, F.col(prob))).alias(f"prob_model_{m}") for m in models]
    labels = [] if label is None else [F.max(F.when(F.col(model) == models[0], F.col(label))).alias(label)]
    return scores.where(F.col(model).isin(list(models))).groupBy(id).agg(*columns, *labels)


def ensemble_key_check(scores: DataFrame, models: Sequence, id: str = "id", model: str = "model", label: str = "class") -> DataFrame:
    """For each further model: ids that it or the first model lacks, and ids with another class."""
    first, others = models[0], list(models[1:])
    wide = scores.groupBy(id).agg(
        *[F.count(F.when(F.col(model) == m, F.lit(1))).alias(f"n_{m}") for m in models],
        *[F.max(F.when(F.col(model) == m, F.col(label))).alias(f"c_{m}") for m in models],
    )
    per_model = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                ((F.col(f"n_{m}") > 0) != (F.col(f"n_{first}") > 0)).alias("key_differs"),
                (F.col(f"c_{m}") != F.col(f"c_{first}")).alias("class_differs"),
            )
            for m in others
        ]
    )
    return (
        wide.select(F.inline(per_model))
        .groupBy("model")
        .agg(
            F.count(F.when(F.col("key_differs"), F.lit(1))).alias("n_key_diff"),
            F.count(F.when(F.col("class_differs"), F.lit(1))).alias("n_class_diff"),
        )
    )


def stacking_features(wide: DataFrame, models: Sequence) -> DataFrame:
    """Complements and means of the model probabilities."""
    names = [f"prob_model_{m}" for m in models]
    wide = wide.withColumns({f"{c}_0": complement(F.col(c)) for c in names})
    return wide.withColumns(
        {"prob_mean": row_mean(*[F.col(c) for c in names]), "prob_mean_0": row_mean(*[F.col(f"{c}_0") for c in names])}
    )


def stacking_columns(models: Sequence) -> list[str]:
    names = [f"prob_model_{m}" for m in models]
    return [*names, *[f"{c}_0" for c in names], "prob_mean", "prob_mean_0"]


def shuffle_key(id: str, seed: int) -> Column:
    """A value that orders rows as if at random, the same in every run and engine."""
    return F.md5(F.concat_ws("-", F.col(id).cast("string"), F.lit(str(seed))))


def stratified_folds(df: DataFrame, label: str, id: str, folds: int = 10, seed: int = 1, name: str = "fold") -> DataFrame:
    """Fold 1..folds per row: each class cut into equal parts of a random order.

    Only label and id are ranked. What comes back is the last value of each part,
    ``folds`` per class, and every row finds its fold by comparing with these, so
    the full rows are neither sorted nor shuffled.
    """
    narrow = df.select(F.col(label).alias("__label"), _position(id, seed).alias("__at"))
    ranked = numbered(narrow, [F.col("__at").asc()], "__n", by=["__label"])
    sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__size"))
    part = F.floor((F.col("__n") - 1) * folds / F.col("__size")).cast("int")
    ends = (
        ranked.join(sizes, F.col("__label").eqNullSafe(F.col("__l")))
        .groupBy("__label", part.alias("__part"))
        .agg(F.max("__at").alias("__end"))
        .groupBy("__label")
        .agg(F.sort_array(F.collect_list(F.struct("__part", "__end"))).alias("__ends"))
    )
    # One row per class; written, so that each use of the folds only looks them up,
    # and broadcast if there are few, so that a class with most rows isn't shuffled to one task.
    ends = small(pinned(ends))
    placed = df.withColumn("__at", _position(id, seed)).join(ends, F.col(label).eqNullSafe(F.col("__label")))
    reached = F.filter("__ends", lambda e: e["__end"] >= F.col("__at"))[0]["__part"]
    return placed.select(*df.columns, (reached + 1).alias(name))


def _position(id: str, seed: int) -> Column:
    """Place of a row in the random order; the id settles equal keys."""
    return F.struct(shuffle_key(id, seed).alias("key"), F.col(id).alias("id"))


def fold_split(df: DataFrame, i: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Rest as train, fold ``i`` as test."""
    return df.where(F.col(fold) != i), df.where(F.col(fold) == i)


def rank_ids(df: DataFrame, id: str = "id", prob: str = "prob") -> DataFrame:
    """Rank 1 for the highest score; equal scores by id, rows without a score last."""
    return numbered(df.select(id, prob), [no_nan(F.col(prob)).desc_nulls_last(), F.col(id).asc()], "rank")


def top_n_ids(df: DataFrame, n: int = 7664, id: str = "id", prob: str = "prob") -> DataFrame:
    """The n highest scores, rows without a score last; each task keeps at most n rows."""
    return df.select(id, prob).orderBy(no_nan(F.col(prob)).desc_nulls_last(), F.col(id).asc()).limit(n)


def downsample_majority(df: DataFrame, label: str, majority: str, id: str, ratio: float = 1.5, seed: int = 1) -> DataFrame:
    """All rows of the other classes, and ``ratio`` times as many of the majority, drawn at random.

    Ids are ranked in a random order; the full rows are only compared with the
    last one drawn.
    """
    is_major = F.col(label) == majority
    quota = df.where(~is_major).agg(F.round(F.count(F.lit(1)) * F.lit(ratio)).cast("bigint")).scalar()
    narrow = df.where(is_major).select(_position(id, seed).alias("__at"))
    last = numbered(narrow, [F.col("__at").asc()], "__n").where(F.col("__n") <= quota).agg(F.max("__at")).scalar()
    return df.where(~is_major | (_position(id, seed) <= last))


def oversample_minority(df: DataFrame, label: str, minority: str, id: str, times: int = 50, seed: int = 1) -> DataFrame:
    """All rows, and ``times`` the minority's number of rows drawn from it with replacement."""
    small = numbered(df.where(F.col(label) == minority), [F.col(id).asc()], "__n")
    size = df.where(F.col(label) == minority).agg(F.count(F.lit(1))).scalar()
    draws = small.select(F.col(id).alias("__id"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("__draw"))
    text = F.concat_ws("-", F.col("__id").cast("string"), F.col("__draw").cast("string"), F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    # Draws per row differ little from each other, so the join key is even.
    picked = draws.select((number % size + 1).alias("__n")).join(small, "__n").drop("__n")
    return df.unionByName(picked.select(*df.columns))
