"""Judging scores: profit by cutoff, cumulative profit, AUC, log-loss.

A score table has an id, a probability and a class (1 is a hit). ``by`` names
group columns such as fold or model; a group may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import no_nan
from tidepanel.operators.running import running_totals

# Payoff of a hit, cost of a miss, cutoff grid and operating cutoff.
GAIN = 11700
COST = 300
CUTOFF_STEPS = 100
CUTOFF_UNIT = 1000
DEFAULT_CUTOFF = 0.025
PROFIT_BAND = (7_490_000, 7_510_000)


def payoff(label: Column, gain: int = GAIN, cost: int = COST) -> Column:
    return F.when(label == 1, F.lit(gain)).otherwise(F.lit(-cost)).cast("bigint")


def profit_at_cutoff(
    df: DataFrame, cutoff: float, prob: str = "prob", label: str = "class", gain: int = GAIN, cost: int = COST, by: Sequence[str] = ()
) -> DataFrame:
    """Profit of acting on all scores above (not at) the cutoff."""
    value = F.when(no_nan(F.col(prob)) > cutoff, payoff(F.col(label), gain, cost)).otherwise(F.lit(0).cast("bigint"))
    return df.groupBy(*by).agg(F.sum(value).alias("profit"))


def cutoffs_passed(prob: Column, steps: int = CUTOFF_STEPS, unit: int = CUTOFF_UNIT) -> Column:
    """How many of the cutoffs 0/unit, 1/unit .. steps/unit lie below the probability.

    The rounded product can miss by one at a grid point, so both neighbours are
    tested with the comparison that defines a cutoff. A missing probability
    passes none.
    """
    prob = no_nan(prob)
    guess = F.ceil(prob * unit)
    exact = (
        F.when(prob > guess / F.lit(float(unit)), guess + 1)
        .when(prob > (guess - 1) / F.lit(float(unit)), guess)
        .otherwise(guess - 1)
    )
    return F.when(prob.isNull(), F.lit(0)).otherwise(F.greatest(F.least(exact, F.lit(steps + 1)), F.lit(0))).cast("int")


def cutoff_sweep(
    df: DataFrame, prob: str = "prob", label: str = "class", gain: int = GAIN, cost: int = COST,
    steps: int = CUTOFF_STEPS, unit: int = CUTOFF_UNIT, by: Sequence[str] = (),
) -> DataFrame:
    """For each cutoff k/unit: rows above it, hits among them, and their profit.

    Equals comparing every score with every cutoff, but each row is counted once
    under the number of cutoffs it passes; only the at most ``steps + 2`` sums of
    a group are then spread over the cutoffs.
    """
    counted = df.groupBy(*by, cutoffs_passed(F.col(prob), steps, unit).alias("__passed")).agg(
        F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col(label) == 1, F.lit(1))).alias("__hits")
    )
    spread = counted.select(*by, "__passed", "__n", "__hits", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    reached = F.col("k") < F.col("__passed")
    zero = F.lit(0).cast("bigint")
    sums = spread.groupBy(*by, "k").agg(
        F.sum(F.when(reached, F.col("__n")).otherwise(zero)).alias("n_above"),
        F.sum(F.when(reached, F.col("__hits")).otherwise(zero)).alias("hits"),
    )
    profit = F.col("hits") * F.lit(gain) - (F.col("n_above") - F.col("hits")) * F.lit(cost)
    return sums.select(
        *by, "k", (F.col("k") / F.lit(float(unit))).alias("cutoff"), "n_above", "hits", profit.cast("bigint").alias("profit")
    )


def best_cutoff(sweep: DataFrame, tie: str = "min", by: Sequence[str] = ()) -> DataFrame:
    """Cutoff of the largest profit; several may share it: take ``min``, ``max`` or ``all``."""
    if tie == "all":
        return _rows_at_max(sweep, "profit", by).select(*by, "cutoff", "profit")
    direction = {"min": -1, "max": 1}[tie]
    best = F.max(F.struct("profit", (F.col("cutoff") * direction).alias("signed")))
    return sweep.groupBy(*by).agg(best.alias("s")).select(*by, (F.col("s.signed") * direction).alias("cutoff"), "s.profit")


def _rows_at_max(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    if not by:
        return df.where(F.col(column) == df.agg(F.max(column)).scalar())
    top = df.groupBy(*by).agg(F.max(column).alias("__top"))
    return df.join(top, list(by)).where(F.col(column) == F.col("__top")).drop("__top")


def profit_default_cutoff(sweep: DataFrame, cutoff: float = DEFAULT_CUTOFF, unit: int = CUTOFF_UNIT, by: Sequence[str] = ()) -> DataFrame:
    return sweep.where(F.col("k") == round(cutoff * unit)).select(*by, "cutoff", "profit")


def perfect_profit(df: DataFrame, label: str = "class", gain: int = GAIN, by: Sequence[str] = ()) -> DataFrame:
    """Profit of acting on all hits and nothing else."""
    return df.groupBy(*by).agg((F.count(F.when(F.col(label) == 1, F.lit(1))) * F.lit(gain)).cast("bigint").alias("perfect_profit"))


def profit_ratio(profit: Column, perfect: Column, digits: int = 5) -> Column:
    return F.round(F.try_divide(profit.cast("double"), perfect.cast("double")), digits)


def profit_curve(
    df: DataFrame, id: str = "id", prob: str = "prob", label: str = "class", gain: int = GAIN, cost: int = COST, by: Sequence[str] = ()
) -> DataFrame:
    """Rows from the highest score down, with their rank and the profit so far.

    Equal scores follow each other by id, so the curve is the same in every run; rows without a score come last.
    """
    return running_totals(
        df,
        [no_nan(F.col(prob)).desc_nulls_last(), F.col(id).asc()],
        sums={"rank": F.lit(1).cast("bigint"), "profit_acum": payoff(F.col(label), gain, cost)},
        by=by,
    )


def profit_curve_peak(curve: DataFrame, prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """First row of the largest cumulative profit: its rank, score and profit."""
    peak = F.max(F.struct(F.col("profit_acum"), (-F.col("rank")).alias("r"), F.col(prob).alias("p")))
    return curve.groupBy(*by).agg(peak.alias("s")).select(
        *by, (-F.col("s.r")).alias("rank"), F.col("s.p").alias(prob), F.col("s.profit_acum").alias("profit_acum")
    )


def profit_curve_peak_rows(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All rows that share the largest cumulative profit."""
    return _rows_at_max(curve, "profit_acum", by)


def counts_at_best(curve: DataFrame, prob: str = "prob", label: str = "class") -> DataFrame:
    """Rows, hits and misses with a score not below that of the peak."""
    threshold = profit_curve_peak(curve, prob).select(prob).scalar()
    return curve.where(F.col(prob) >= threshold).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(label) == 1, F.lit(1))).alias("hits"),
        F.count(F.when(F.col(label) == 0, F.lit(1))).alias("misses"),
    )


def prob_in_profit_band(curve: DataFrame, low: int = PROFIT_BAND[0], high: int = PROFIT_BAND[1], prob: str = "prob") -> DataFrame:
    """Mean score where the cumulative profit lies in a band: an operating cutoff."""
    return curve.where(F.col("profit_acum").between(low, high)).agg(F.avg(prob).alias("cutoff"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, prob: str = "prob", label: str = "class", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, exact and with ties counted half.

    Rows are merged by score first; the rank of a score is the running count of
    lower ones. Null when one of the classes is absent. Rows without a score or label are left out.
    """
    merged = df.where(no_nan(F.col(prob)).isNotNull() & F.col(label).isNotNull()).groupBy(*by, prob).agg(
        F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col(label) == 1, F.lit(1))).alias("__pos")
    )
    ranked = running_totals(merged, [F.col(prob).asc()], sums={"__upto": F.col("__n")}, by=by)
    mean_rank = F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)
    sums = ranked.groupBy(*by).agg(
        F.sum("__n").alias("n"), F.sum("__pos").alias("n_pos"), F.sum(mean_rank * F.col("__pos")).alias("__ranks")
    )
    n1 = F.col("n_pos").cast("double")
    n0 = (F.col("n") - F.col("n_pos")).cast("double")
    return sums.select(*by, "n", "n_pos", F.try_divide(F.col("__ranks") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def logloss_term(prob: Column, label: Column, eps: float = 1e-15) -> Column:
    """Null without a score or label, so that a mean passes over the row."""
    known = no_nan(prob)
    p = F.greatest(F.least(known, F.lit(1 - eps)), F.lit(eps))
    term = F.when(label == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))
    return F.when(known.isNotNull() & label.isNotNull(), -term)


def logloss(df: DataFrame, prob: str = "prob", label: str = "class", eps: float = 1e-15, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(logloss_term(F.col(prob), F.col(label), eps)).alias("logloss"))


def metrics_over_repeats(trials: DataFrame, trial: str, means: Sequence[str], total: str, digits: int | None = 5) -> DataFrame:
    """Mean of each metric over the repeats of a trial, and the time they took together."""

    def mean(c: str) -> Column:
        return F.avg(c) if digits is None else F.round(F.avg(c), digits)

    return trials.groupBy(trial).agg(*[mean(c).alias(c) for c in means], F.round(F.sum(total), 2).alias(total))


def fold_metrics(df: DataFrame, fold: str = "fold", id: str = "id", prob: str = "prob", label: str = "class", gain: int = GAIN, cost: int = COST) -> DataFrame:
    """Per fold: AUC, log-loss, peak profit, its share of the perfect profit, and that share of the whole set's.

    The scores are read three times; hand over a written table if they are costly to make.
    """
    peak = profit_curve_peak(profit_curve(df, id, prob, label, gain, cost, by=[fold]), prob, by=[fold])
    sums = df.groupBy(fold).agg(
        F.avg(logloss_term(F.col(prob), F.col(label))).alias("logloss"),
        (F.count(F.when(F.col(label) == 1, F.lit(1))) * F.lit(gain)).cast("double").alias("perfect_profit"),
    )
    whole = sums.agg(F.sum("perfect_profit")).scalar()
    ratio = F.try_divide(F.col("profit_acum").cast("double"), F.col("perfect_profit"))
    return (
        auc(df, prob, label, by=[fold]).select(fold, "auc")
        .join(sums, fold)
        .join(peak.select(fold, "profit_acum"), fold)
        .select(fold, "auc", "logloss", ratio.alias("profit_ratio"), (ratio * whole).alias("profit"))
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """Means over folds."""
    return folds.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.round(F.avg("auc"), 5).alias("auc"),
        F.round(F.avg("logloss"), 5).alias("logloss"),
        F.round(F.avg("profit_ratio"), 2).alias("profit_ratio"),
        F.round(F.avg("profit"), 0).alias("profit"),
    )
