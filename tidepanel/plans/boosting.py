"""Training jobs on symmetric trees: all models of a job are grown together, in the jobs and scans of one."""

from __future__ import annotations

import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import encode, ensemble, evaluate
from tidepanel.operators.boost import Binning, BoostParams, Forest, Model, learn_bins, train_models, train_rows
from tidepanel.plans.training import Box, Task, evaluate_scores, mean_metrics
from tidepanel.session import pinned


def row_id(columns: Sequence[str]):
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def seeds_matter(params: BoostParams, n_models: int) -> None:
    if n_models > 1 and not params.bagging_temperature and not params.random_strength:
        raise ValueError("models without row weights and noise do not differ by their seed")


def encode_task(task: Task, categorical: Sequence[str] = (), prior: float = encode.PRIOR, weight: float = 1.0, seed: int = 1) -> Task:
    """The task with its category columns replaced by target statistics: of earlier rows in train, of all train rows in test."""
    columns = tuple(categorical or task.categorical)
    train, test = task.train.withColumn("__order", F.concat_ws("-", *[F.col(c).cast("string") for c in task.id])), task.test
    for c in columns:
        totals = pinned(encode.target_totals(task.train, c, task.label))
        train = encode.ordered_target_statistics(train, c, task.label, "__order", prior=prior, weight=weight, seed=seed)
        test = encode.with_target_statistics(test, totals, c, prior=prior, weight=weight)
    features = tuple(f"{f}__ts" if f in columns else f for f in task.features)
    return replace(task, train=train.drop("__order"), test=test, features=features, categorical=())


def bagging(
    train: DataFrame, features: Sequence[str], label: str, id: Sequence[str], params: BoostParams = BoostParams(), n_models: int = 10,
) -> Forest:
    """Models that differ in their seed, in one pass; their mean is the score."""
    seeds_matter(params, n_models)
    known = train.where(F.col(label).isNotNull())
    binning = learn_bins(known, features, params.border_count)
    return train_models(train_rows(binning, known, label, row_id(id)), binning, [Model(replace(params, seed=s)) for s in range(1, n_models + 1)])


def dealt_rows(df: DataFrame, features: Sequence[str], label: str, id: Sequence[str], folds: int, border_count: int) -> tuple[Binning, DataFrame]:
    """Binned rows with their fold, written once. Borders are those of all rows; labels play no part in them."""
    dealt = ensemble.stratified_folds(df.where(F.col(label).isNotNull()).withColumn("__id", row_id(id)), label, "__id", folds)
    binning = learn_bins(dealt, features, border_count)
    rows = train_rows(binning, dealt.withColumn("id", F.col("__id")), label, F.col("__id"), "fold", keep=("id",))
    return binning, pinned(rows)


def stratified_cv(
    df: DataFrame, features: Sequence[str], label: str, id: Sequence[str], params: BoostParams = BoostParams(depth=2), folds: int = 10, n_models: int = 10,
) -> DataFrame:
    """Metrics of bagged models per fold, for the train and the test side; folds x models trainings in one pass."""
    seeds_matter(params, n_models)
    binning, rows = dealt_rows(df, features, label, id, folds, params.border_count)
    models = [Model(replace(params, seed=s), held_out=i) for i in range(1, folds + 1) for s in range(1, n_models + 1)]
    forest = train_models(rows.drop("id"), binning, models)
    by_fold = forest.score_groups(
        rows.select("id", "fold", F.col("label").cast("int").alias("class"), "bins"), [[m for m, x in enumerate(models) if x.held_out == i] for i in range(1, folds + 1)]
    )
    # Each row is scored once by the models of every fold: it is a test row of its own fold's and a train row of the others'.
    spread = by_fold.select("id", "class", F.col("fold").alias("own"), F.posexplode("probs").alias("pos", "prob")).withColumn("of", F.col("pos") + 1)
    side = F.when(F.col("of") == F.col("own"), "test").otherwise("train")
    scored = pinned(spread.select(F.format_string("%s-%02d", side, F.col("of")).alias("fold"), "id", "prob", "class"))
    train_metrics = evaluate.fold_metrics(scored.where(F.col("fold").startswith("train")))
    # Each row is in the train side of all folds but one, so the whole set counts folds - 1 times there.
    train_metrics = train_metrics.withColumn("profit", F.col("profit") / F.lit(float(folds - 1)))
    both = train_metrics.unionByName(evaluate.fold_metrics(scored.where(F.col("fold").startswith("test"))))
    return both.select(
        F.substring_index("fold", "-", 1).alias("sample"), F.substring_index("fold", "-", -1).cast("int").alias("fold"),
        "auc", "logloss", "profit_ratio", "profit",
    )


def stacking(
    scores: DataFrame, models: Sequence, params: BoostParams = BoostParams(depth=2), n_models: int = 10,
) -> tuple[Forest, DataFrame]:
    """Second-level learner on the models' probabilities, their complements and means, and the table it was trained on."""
    wide = pinned(ensemble.stacking_features(ensemble.ensemble_full_join(scores, models), models))
    return bagging(wide, ensemble.stacking_columns(models), "class", ["id"], params, n_models), wide


def score_and_rank(forest: Forest, new_scores: DataFrame, models: Sequence, n: int = 7664) -> DataFrame:
    """Score a new month through the same features and list its first n ids."""
    wide = ensemble.stacking_features(ensemble.ensemble_full_join(new_scores, models, label=None), models)
    return ensemble.top_n_ids(forest.score(wide, "id"), n)


def grid_cv(
    train: DataFrame, features: Sequence[str], label: str, id: Sequence[str], depths: Sequence[int] = (4, 6, 8), folds: int = 4,
    params: BoostParams = BoostParams(iterations=100, border_count=64, l2_leaf_reg=1e-3),
) -> DataFrame:
    """Mean AUC on held-out folds for each depth and its deviation; depths x folds trainings in one pass."""
    binning, rows = dealt_rows(train, features, label, id, folds, params.border_count)
    models = [Model(replace(params, depth=d), held_out=i) for d in depths for i in range(1, folds + 1)]
    forest = train_models(rows.drop("id"), binning, models)
    narrow = rows.select("fold", F.col("label").cast("int").alias("class"), "bins")
    # A model per depth and fold; a row is judged by the models that have not seen its fold.
    probs = forest.score_groups(narrow, [[m] for m in range(len(models))])
    n = len(depths)
    held = F.array(*[F.get("probs", F.lit(k * folds - 1) + F.col("fold")) for k in range(n)])
    scored = pinned(probs.select("fold", "class", F.posexplode(held).alias("at", "prob")))
    areas = evaluate.auc(scored, by=["at", "fold"])
    depth = F.element_at(F.array(*[F.lit(int(d)) for d in depths]), F.col("at") + 1)
    return areas.groupBy(depth.alias("depth")).agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("auc_sd"))


def _both_sides(forest: Forest, task: Task) -> DataFrame:
    """(sample, id, class, probs): the scores of each model for the train and the test rows."""
    parts = [
        forest.score_groups(
            forest.binning.apply(
                side.where(F.col(task.label).isNotNull()).select(
                    F.lit(sample).alias("sample"), row_id(task.id).alias("id"), F.col(task.label).cast("int").alias("class"), *task.features
                ),
                "sample", "id", "class",
            ),
            [[m] for m in range(len(forest.trees))],
        )
        for sample, side in (("train", task.train), ("test", task.test))
    ]
    return reduce(DataFrame.unionByName, parts)


def repeat_trial(task: Task, params: BoostParams = BoostParams(), repeats: int = 3, cutoff: float | None = None) -> dict:
    """Mean metrics of several trainings that differ in their seed, grown and scored together."""
    started = time.monotonic()
    forest = bagging(task.train, task.features, task.label, task.id, params, repeats)
    minutes = round((time.monotonic() - started) / 60, 2)
    scored = pinned(_both_sides(forest, task))
    runs = [evaluate_scores(scored.select("sample", "id", "class", F.get("probs", F.lit(m)).alias("prob")), cutoff) for m in range(repeats)]
    return {**mean_metrics(runs), "minutes_taken": minutes}


def train_eval(task: Task, params: BoostParams = BoostParams(), cutoff: float | None = None) -> dict:
    """Train once, score both samples, and return all metrics with the minutes of training."""
    return repeat_trial(task, params, 1, cutoff)


# Searched ranges of the two long searches. Borders are shared by all models of a pass, so their number is not searched.
REPEATED_BOX = Box({
    "depth": (6, 10), "iterations": (500, 1200), "l2_leaf_reg": (1, 30), "learning_rate": (1e-7, 1.0), "random_strength": (1.0, 20.0), "bagging_temperature": (0.0, 20.0),
})
CUTOFF_BOX = Box({
    "depth": (1, 10), "iterations": (250, 1250), "l2_leaf_reg": (1, 10), "learning_rate": (1e-7, 1.0), "cutoff": (0.01, 0.1), "random_strength": (1, 20),
})


def judge_models(scored: DataFrame, cutoffs: Mapping[int, float]) -> DataFrame:
    """(model, profit, cutoff, objective, auc_testing, logloss_testing) for all models of (sample, id, class, probs), in grouped passes.

    The profit is that of the model's own cutoff, or the best of the sweep; the objective is its share of the perfect one.
    """
    rows = pinned(scored.where(F.col("sample") == "test").select("id", "class", F.posexplode("probs").alias("model", "prob")))
    sweep = evaluate.cutoff_sweep(rows, by=["model"])
    best = evaluate.best_cutoff(sweep, "max", by=["model"])
    if cutoffs:
        own = F.element_at(F.create_map(*[F.lit(x) for m, c in cutoffs.items() for x in (int(m), float(c))]), F.col("model"))
        value = F.when(F.col("prob") > own, evaluate.payoff(F.col("class"))).otherwise(F.lit(0).cast("bigint"))
        best = rows.groupBy("model").agg(F.max(own).alias("cutoff"), F.sum(value).alias("profit"))
    ratio = F.coalesce(evaluate.profit_ratio(F.col("profit"), F.col("perfect_profit")), F.lit(0.0))
    return (
        best.join(evaluate.perfect_profit(rows, by=["model"]), "model")
        .join(evaluate.auc(rows, by=["model"]).select("model", F.round("auc", 5).alias("auc_testing")), "model")
        .join(evaluate.logloss(rows, by=["model"]).select("model", F.round("logloss", 5).alias("logloss_testing")), "model")
        .select("model", F.col("profit").cast("double").alias("profit"), "cutoff", ratio.alias("objective"), "auc_testing", "logloss_testing")
    )


def param_sweep(task: Task, box: Box = CUTOFF_BOX, trials: int = 200, seed: int = 1, base: BoostParams = BoostParams(), repeats: int = 1) -> list[dict]:
    """Draw points of the box, grow the models of all points together, judge them; best objective first.

    With ``repeats`` a trial is that many models of different seeds, and its metrics are their means.
    """
    rng = random.Random(seed)
    points = [box.draw(rng) for _ in range(trials)]
    settings = [{k: v for k, v in point.items() if k != "cutoff"} for point in points]
    if any("border_count" in s for s in settings):
        raise ValueError("models of one pass share their borders: set border_count in base")
    known = task.train.where(F.col(task.label).isNotNull())
    binning = learn_bins(known, task.features, base.border_count)
    models = [Model(replace(base, seed=base.seed + k, **s)) for s in settings for k in range(repeats)]
    forest = train_models(train_rows(binning, known, task.label, row_id(task.id)), binning, models)
    cutoffs = {i * repeats + k: p["cutoff"] for i, p in enumerate(points) if "cutoff" in p for k in range(repeats)}
    judged = {r["model"]: r.asDict() for r in judge_models(_both_sides(forest, task), cutoffs).collect()}
    found = []
    for i, point in enumerate(points):
        own = [judged[m] for m in range(i * repeats, (i + 1) * repeats) if m in judged]
        means = mean_metrics([{k: v for k, v in r.items() if k != "model"} for r in own]) if own else {}
        found.append({**means, "trial": i + 1, "hyperparams": point})
    return sorted(found, key=lambda r: (-(r.get("objective") or 0.0), r["trial"]))


def staged_metrics(forest: Forest, test: DataFrame, label: str, model: int = 0) -> DataFrame:
    """What a shorter training would have got: for each number of trees the best profit, its cutoff, the profit at the default cutoff and the log-loss.

    One pass over ``test``: a row's score after each tree is a running sum, and rows are counted under (trees, cutoffs passed) before anything is shuffled.
    """
    known = test.where(F.col(label).isNotNull()).withColumn("class", F.col(label).cast("int"))
    steps = forest.staged(known, "class", model=model).select("class", F.posexplode("probs").alias("at", "prob")).withColumn("trees", F.col("at") + 1)
    term = evaluate.logloss_term(F.col("prob"), F.col("class"))
    counted = steps.groupBy("trees", evaluate.cutoffs_passed(F.col("prob")).alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("class") == 1, F.lit(1))).alias("hits"), F.sum(term).alias("loss")
    )
    return staged_summary(pinned(counted))


def staged_summary(counted: DataFrame) -> DataFrame:
    """Metrics per number of trees from (trees, passed, n, hits, loss)."""
    spread = counted.select("trees", "passed", "n", "hits", F.explode(F.sequence(F.lit(0), F.lit(evaluate.CUTOFF_STEPS))).alias("k"))
    reached = F.col("k") < F.col("passed")
    value = F.col("hits") * F.lit(evaluate.GAIN) - (F.col("n") - F.col("hits")) * F.lit(evaluate.COST)
    sweep = spread.groupBy("trees", "k").agg(F.sum(F.when(reached, value).otherwise(F.lit(0).cast("bigint"))).alias("profit"))
    at_default = F.max(F.when(F.col("k") == round(evaluate.DEFAULT_CUTOFF * evaluate.CUTOFF_UNIT), F.col("profit")))
    best = sweep.groupBy("trees").agg(F.max(F.struct("profit", "k")).alias("top"), at_default.alias("profit_0025"))
    losses = counted.groupBy("trees").agg((F.sum("loss") / F.sum("n")).alias("logloss"))
    return best.join(losses, "trees").select(
        "trees", F.col("top.profit").alias("profit"), (F.col("top.k") / F.lit(float(evaluate.CUTOFF_UNIT))).alias("cutoff"), "profit_0025", "logloss"
    )
