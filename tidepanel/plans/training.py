"""Training jobs: hold-out by period, repeats, bagging, folds, stacking, searches, plan queue."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import ensemble, evaluate
from tidepanel.operators.ledger import Ledger
from tidepanel.operators.learn import FEATURES, LearnerParams, Preparation, Trained, prepare
from tidepanel.session import pinned, shared_dir


def holdout_by_period(df: DataFrame, period: str, train_periods: Sequence[int], test_periods: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Train on some months, test on others."""
    return df.where(F.col(period).isin(list(train_periods))), df.where(F.col(period).isin(list(test_periods)))


@dataclass(frozen=True)
class Task:
    """Train and test table with a 0/1 label in each."""

    train: DataFrame
    test: DataFrame
    features: tuple[str, ...]
    id: tuple[str, ...]
    label: str = "target"
    categorical: tuple[str, ...] = ()


def _row_key(columns: Sequence[str]):
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns]).alias("id")


@dataclass(frozen=True)
class Pool:
    """Labelled feature vectors of a task, written once for all trainings and searches on it."""

    preparation: Preparation
    train: DataFrame
    test: DataFrame
    label: str
    id: tuple[str, ...]

    def fit(self, params: LearnerParams) -> Trained:
        estimator = params.estimator(self.label, self.preparation.largest_category)
        return Trained(self.preparation, (estimator.fit(self.train.select(self.label, FEATURES)),))

    def scores(self, trained: Trained) -> DataFrame:
        """Scores of both samples under each other."""
        parts = [
            trained.score_vectors(side, *self.id, self.label).select(
                F.lit(sample).alias("sample"), _row_key(self.id), "prob", F.col(self.label).cast("int").alias("class")
            )
            for sample, side in (("train", self.train), ("test", self.test))
        ]
        return parts[0].unionByName(parts[1])


def load_pool(task: Task) -> Pool:
    """Rows without a label are left out; how to fill and code features is learnt from the train rows."""
    train, test = (df.where(F.col(task.label).isNotNull()) for df in (task.train, task.test))
    preparation = prepare(train, task.features, task.categorical)
    written = [pinned(preparation.apply(df, *task.id, task.label)) for df in (train, test)]
    return Pool(preparation, *written, task.label, task.id)


def evaluate_scores(scores: DataFrame, cutoff: float | None = None, tie: str = "max") -> dict:
    """All metrics of train and test scores, rounded to 5 digits.

    ``cutoff`` fixes the operating cutoff; otherwise it is the best of the sweep.
    """
    scores = pinned(scores)
    test = scores.where(F.col("sample") == "test")
    sweep = evaluate.cutoff_sweep(test).collect()
    perfect = evaluate.perfect_profit(test).first()["perfect_profit"]
    if cutoff is None:
        top = max(r["profit"] for r in sweep)
        tied = [r["cutoff"] for r in sweep if r["profit"] == top]
        cutoff, profit = (min(tied) if tie == "min" else max(tied)), top
    else:
        profit = evaluate.profit_at_cutoff(test, cutoff).first()["profit"]
    at_default = next(r["profit"] for r in sweep if r["k"] == round(evaluate.DEFAULT_CUTOFF * evaluate.CUTOFF_UNIT))
    areas = {r["sample"]: r["auc"] for r in evaluate.auc(scores, by=["sample"]).collect()}
    losses = {r["sample"]: r["logloss"] for r in evaluate.logloss(scores, by=["sample"]).collect()}

    def rounded(v):
        return None if v is None else round(float(v), 5)

    def ratio(v):
        return rounded(v / perfect) if perfect else None

    return {
        "profit": float(profit), "profit_0025": float(at_default), "perfect_profit": float(perfect), "cutoff": float(cutoff),
        "perfect_profit_ratio": ratio(profit), "perfect_profit_ratio_0025": ratio(at_default),
        "auc_training": rounded(areas.get("train")), "auc_testing": rounded(areas.get("test")),
        "logloss_training": rounded(losses.get("train")), "logloss_testing": rounded(losses.get("test")),
    }


def train_eval(pool: Pool, params: LearnerParams = LearnerParams(), cutoff: float | None = None) -> dict:
    """Train once, score both samples, and return all metrics with the minutes of training."""
    started = time.monotonic()
    trained = pool.fit(params)
    minutes = round((time.monotonic() - started) / 60, 2)
    return {**evaluate_scores(pool.scores(trained), cutoff), "minutes_taken": minutes}


def mean_metrics(runs: Sequence[Mapping]) -> dict:
    means = {}
    for name in runs[0]:
        known = [r[name] for r in runs if r[name] is not None]
        if name == "minutes_taken":
            means[name] = round(sum(known), 2)
        else:
            means[name] = round(sum(known) / len(known), 5) if known else None
    return means


def repeat_trial(pool: Pool, params: LearnerParams = LearnerParams(), repeats: int = 3, cutoff: float | None = None) -> dict:
    """Mean metrics of several trainings that differ in their seed."""
    params.seeds_matter(repeats)
    return mean_metrics([train_eval(pool, replace(params, seed=seed), cutoff) for seed in range(1, repeats + 1)])


def _in_parallel(spark: SparkSession, jobs: Sequence[Callable], parallelism: int) -> list:
    """Start independent Spark jobs from several driver threads; results in order."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def bagging(
    train: DataFrame, features: Sequence[str], label: str, params: LearnerParams = LearnerParams(), n_models: int = 10,
    categorical: Sequence[str] = (), parallelism: int = 2,
) -> Trained:
    """Models that differ in their seed, on one cached feature table; their mean is the score."""
    params.seeds_matter(n_models)
    shared_dir(train.sparkSession)
    known = train.where(F.col(label).isNotNull())
    preparation = prepare(known, features, categorical)
    table = preparation.apply(known, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        estimators = [replace(params, seed=s).estimator(label, preparation.largest_category) for s in range(1, n_models + 1)]
        models = _in_parallel(train.sparkSession, [lambda e=e: e.fit(table) for e in estimators], parallelism)
    finally:
        table.unpersist()
    return Trained(preparation, tuple(models))


def stratified_cv(
    df: DataFrame, features: Sequence[str], label: str, id: Sequence[str], params: LearnerParams = LearnerParams(),
    folds: int = 10, n_models: int = 10, parallelism: int = 2,
) -> DataFrame:
    """Metrics of bagged models per fold, for the train and the test side."""
    dealt = pinned(ensemble.stratified_folds(df.withColumn("__id", _row_key(id)), label, "__id", folds))
    parts = []
    for i in range(1, folds + 1):
        rest, held = ensemble.fold_split(dealt, i)
        trained = bagging(rest, features, label, params, n_models, parallelism=parallelism)
        for sample, side in (("train", rest), ("test", held)):
            scores = trained.score(side, "__id", label)
            parts.append(
                scores.select(
                    F.lit(f"{sample}-{i:02d}").alias("fold"), F.col("__id").alias("id"), "prob", F.col(label).cast("int").alias("class")
                )
            )
    # Scored once: the four metrics all read the written rows.
    scored = pinned(reduce(DataFrame.unionByName, parts))
    train_metrics = evaluate.fold_metrics(scored.where(F.col("fold").startswith("train")))
    # Each row is in the train side of all folds but one, so the whole set counts folds - 1 times there.
    train_metrics = train_metrics.withColumn("profit", F.col("profit") / F.lit(float(folds - 1)))
    test_metrics = evaluate.fold_metrics(scored.where(F.col("fold").startswith("test")))
    both = train_metrics.unionByName(test_metrics)
    return both.select(
        F.substring_index("fold", "-", 1).alias("sample"), F.substring_index("fold", "-", -1).cast("int").alias("fold"),
        "auc", "logloss", "profit_ratio", "profit",
    )


def stacking(
    scores: DataFrame, models: Sequence, params: LearnerParams = LearnerParams(depth=2), n_models: int = 10, parallelism: int = 2
) -> tuple[Trained, DataFrame]:
    """Second-level learner on the models' probabilities, their complements and means.

    Returns the learner and the table it was trained on. Missing probabilities
    are a value of their own to the learner, so no id is lost.
    """
    wide = pinned(ensemble.stacking_features(ensemble.ensemble_full_join(scores, models), models))
    trained = bagging(wide, ensemble.stacking_columns(models), "class", params, n_models, parallelism=parallelism)
    return trained, wide


def score_and_rank(trained: Trained, new_scores: DataFrame, models: Sequence, n: int = 7664) -> DataFrame:
    """Score a new month through the same features and list its first n ids."""
    wide = ensemble.stacking_features(ensemble.ensemble_full_join(new_scores, models, label=None), models)
    return ensemble.top_n_ids(trained.score(wide, "id"), n)


def grid_cv(
    train: DataFrame, features: Sequence[str], label: str, depths: Sequence[int] = (4, 6, 8), folds: int = 4,
    params: LearnerParams = LearnerParams(iterations=100, border_count=64), categorical: Sequence[str] = (), parallelism: int = 2,
) -> DataFrame:
    """Mean cross-validated AUC for each depth; one row per depth."""
    shared_dir(train.sparkSession)
    known = train.where(F.col(label).isNotNull())
    preparation = prepare(known, features, categorical)
    estimator = params.estimator(label, preparation.largest_category)
    grid = ParamGridBuilder().addGrid(estimator.maxDepth, list(depths)).build()
    judge = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, parallelism=parallelism, seed=1)
    table = preparation.apply(known, F.col(label).cast("double").alias(label)).select(FEATURES, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = cv.fit(table)
    finally:
        table.unpersist()
    rows = [(int(d), float(m), float(s)) for d, m, s in zip(depths, fitted.avgMetrics, fitted.stdMetrics)]
    return train.sparkSession.createDataFrame(rows, "depth int, auc double, auc_sd double")


@dataclass(frozen=True)
class Box:
    """Bounds of the searched parameters: whole numbers for int bounds, else reals; ``log`` names are drawn on a log scale."""

    bounds: Mapping[str, tuple[float, float]]
    log: tuple[str, ...] = ("learning_rate",)

    def draw(self, rng: random.Random) -> dict:
        point = {}
        for name, (low, high) in self.bounds.items():
            if isinstance(low, int) and isinstance(high, int):
                point[name] = rng.randint(low, high)
            elif name in self.log:
                point[name] = low * (high / low) ** rng.random()
            else:
                point[name] = rng.uniform(low, high)
        return point


# Searched ranges of the three searches, for the parameters this learner has.
REPEATED_BOX = Box({"depth": (6, 10), "iterations": (500, 1200), "learning_rate": (1e-7, 1.0)})
CUTOFF_BOX = Box({"depth": (1, 10), "iterations": (250, 1250), "border_count": (2, 254), "learning_rate": (1e-7, 1.0), "cutoff": (0.01, 0.1)})
DEFAULT_CUTOFF_BOX = Box({"depth": (6, 10), "iterations": (250, 1250), "border_count": (128, 254), "learning_rate": (1e-7, 1.0)})


def objective_mean_profit(pool: Pool, params: LearnerParams, cutoff: float | None = None) -> dict:
    """Best profit of the sweep, mean of three trainings."""
    found = repeat_trial(pool, params, 3)
    return {**found, "objective": found["profit"]}


def objective_ratio_at_cutoff(pool: Pool, params: LearnerParams, cutoff: float | None = None) -> dict:
    """Share of the perfect profit at a cutoff that is searched too (or the default one)."""
    found = train_eval(pool, params, evaluate.DEFAULT_CUTOFF if cutoff is None else cutoff)
    return {**found, "objective": found["perfect_profit_ratio"] or 0.0}


def param_sweep(
    pool: Pool, box: Box, objective: Callable[..., dict] = objective_ratio_at_cutoff, trials: int = 200, seed: int = 1,
    parallelism: int = 2, base: LearnerParams = LearnerParams(),
) -> list[dict]:
    """Draw points of the box, train and judge each; best objective first."""
    rng = random.Random(seed)
    points = [box.draw(rng) for _ in range(trials)]

    def judge(i: int, point: dict) -> dict:
        settings = {k: v for k, v in point.items() if k != "cutoff"}
        found = objective(pool, replace(base, **settings), point.get("cutoff"))
        return {**found, "trial": i, "hyperparams": point}

    done = _in_parallel(pool.train.sparkSession, [lambda i=i, p=p: judge(i, p) for i, p in enumerate(points, 1)], parallelism)
    return sorted(done, key=lambda r: (-r["objective"], r["trial"]))


def plan_runner(
    ledger: Ledger, load: Callable[[list[int], list[int]], Task], params: LearnerParams = LearnerParams(),
    code: str = "plans", box: Box | None = None, trials: int = 200,
) -> int:
    """Work off the pending plans: load their periods, train, judge, write down, finish.

    With a box each plan is a search and every trial is written down. Returns
    the number of plans done; a plan stays pending until its rows are written,
    so a broken run is taken up again at the same plan.
    """
    done = 0
    while (plan := ledger.next_plan()) is not None:
        train_periods, test_periods = ([int(p) for p in plan[side].split(",")] for side in ("train", "test"))
        pool = load_pool(load(train_periods, test_periods))
        common = {
            "experiment_code": code, "algorithm": "gbt", "train_periods": plan["train"], "test_periods": plan["test"],
            "observation": "", "plan_id": plan["id"],
        }
        if box is None:
            found = train_eval(pool, params)
            ledger.append({**found, **common, "estimation": "no cv"}, asdict(params))
        else:
            for found in param_sweep(pool, box, trials=trials, base=params):
                ledger.append({**found, **common, "estimation": "no cv"}, found["hyperparams"])
        ledger.finish(plan["id"])
        done += 1
    return done
