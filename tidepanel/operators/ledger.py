"""The ledger of plans, experiments and hyperparameters, on append-only Parquet.

A plan is finished by an event row rather than by changing the plan, so that
writing stays an append.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.running import running_totals
from tidepanel.sources import schema as S

# Settings that are no hyperparameters.
NOT_HYPERPARAMS = ("train_dir", "logging_level", "task_type", "loss_function")


def best_row(df: DataFrame, by: str, metric: Column, id: str = "id", largest: bool = True) -> DataFrame:
    """Per group the whole row of the largest (or smallest) metric; of equal ones the first id.

    Rows without a metric only count where a group has no other.
    """
    sign = 1 if largest else -1
    ordered = F.max(F.struct((metric * sign).alias("m"), (-F.col(id)).alias("i"), F.struct(*df.columns).alias("row")))
    return df.groupBy(by).agg(ordered.alias("s")).select((F.col("s.m") * sign).alias("metric"), "s.row.*")


def best_by_max(experiments: DataFrame, metric: str = "perfect_profit_ratio", by: str = "plan_id") -> DataFrame:
    return best_row(experiments, by, F.col(metric))


def best_by_min(experiments: DataFrame, metric: str = "logloss_testing", by: str = "plan_id") -> DataFrame:
    return best_row(experiments, by, F.col(metric), largest=False)


def metric_ratio(over: str = "perfect_profit_ratio", under: str = "logloss_testing") -> Column:
    return F.try_divide(F.col(over), F.col(under))


def best_by_ratio(experiments: DataFrame, over: str = "perfect_profit_ratio", under: str = "logloss_testing", by: str = "plan_id", order: str = "test_periods") -> DataFrame:
    best = best_row(experiments, by, metric_ratio(over, under))
    return best.orderBy(F.col(order).asc(), F.col("metric").desc(), F.col("id").asc())


def metric_listing(experiments: DataFrame, over: str = "perfect_profit_ratio", under: str = "logloss_testing", order: str = "test_periods") -> DataFrame:
    listed = experiments.withColumn("metric", F.round(metric_ratio(over, under), 2))
    return listed.orderBy(F.col(order).asc(), F.col("metric").desc(), F.col("id").asc())


def avg_by_group(experiments: DataFrame, group: str = "test_periods", value: str = "cutoff", digits: int = 3) -> DataFrame:
    return experiments.groupBy(group).agg(F.round(F.avg(value), digits).alias(f"avg_{value}"))


def hyperparams_of_best(hyperparams: DataFrame, best: DataFrame, keep: Sequence[str] = ("test_periods", "train_periods", "metric")) -> DataFrame:
    """Hyperparameters of the best experiment of each plan."""
    chosen = best.select(F.col("id").alias("experiment_id"), *keep)
    joined = hyperparams.join(chosen, "experiment_id")
    return joined.orderBy(F.col(keep[0]).asc(), F.col("metric").desc(), F.col("experiment_id").asc(), F.col("name").asc())


def rows_at_group_max(experiments: DataFrame, metric: str = "profit", by: str = "plan_id") -> DataFrame:
    """Per plan one experiment that reaches the plan's largest profit."""
    return best_row(experiments, by, F.col(metric)).drop("metric")


def search_evolution(experiments: DataFrame, by: str = "plan_id", id: str = "id", minutes: str = "minutes_taken", profit: str = "profit") -> DataFrame:
    """Hours spent so far and best profit so far, per plan in order of the experiments."""
    return running_totals(
        experiments.select(by, id, minutes, profit),
        [F.col(id).asc()],
        sums={"hours": F.col(minutes) / F.lit(60.0)},
        maxima={"best_profit": F.col(profit)},
        by=[by],
    )


def experiments_of_plan(experiments: DataFrame, plan_id: int, by: str = "plan_id") -> DataFrame:
    return experiments.where(F.col(by) == plan_id).orderBy(F.col("profit").desc(), F.col("id").asc())


def hyperparams_of_experiment(hyperparams: DataFrame, experiment_id: int) -> DataFrame:
    return hyperparams.where(F.col("experiment_id") == experiment_id)


def filter_pending_plan(plans: DataFrame) -> DataFrame:
    return plans.where(F.col("finished").isNull())


def next_plan(plans: DataFrame) -> DataFrame:
    """The pending plan of the smallest id."""
    return filter_pending_plan(plans).orderBy("id").limit(1)


def with_events(plans: DataFrame, events: DataFrame) -> DataFrame:
    """Plans with the time of their last finishing event, if any."""
    last = events.groupBy("id").agg(F.max("finished").alias("__finished"))
    return plans.join(last, "id", "left").withColumn("finished", F.coalesce("__finished", "finished")).drop("__finished")


def hyperparams_long(experiments: DataFrame, params: str, id: str = "id") -> DataFrame:
    """A map column to rows (experiment_id, name, value), less what is no hyperparameter."""
    pairs = experiments.select(F.col(id).alias("experiment_id"), F.explode(params).alias("name", "value"))
    return pairs.where(~F.col("name").isin(list(NOT_HYPERPARAMS))).select(
        "experiment_id", "name", F.col("value").cast("string").alias("value")
    )


@dataclass(frozen=True)
class Ledger:
    """The tables below one folder. Appends come from one driver at a time."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], schema)

    def experiments(self) -> DataFrame:
        return self._table("experiments", S.EXPERIMENTS)

    def hyperparams(self) -> DataFrame:
        return self._table("hyperparams", S.HYPERPARAMS)

    def plans(self) -> DataFrame:
        return with_events(self._table("plans", S.PLANS), self._table("plan_events", S.PLAN_EVENTS))

    def add_plans(self, plans: DataFrame) -> None:
        plans.select(*[F.col(f.name).cast(f.dataType) for f in S.PLANS.fields]).write.mode("append").parquet(f"{self.path}/plans")

    def append_frame(self, experiments: DataFrame, params: str | None = None) -> None:
        """Append many experiments at once; ``params`` names a map column."""
        if params is not None:
            hyperparams_long(experiments, params).write.mode("append").parquet(f"{self.path}/hyperparams")
        have = set(experiments.columns)
        typed = [
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EXPERIMENTS.fields
        ]
        experiments.select(*typed).write.mode("append").parquet(f"{self.path}/experiments")

    def append(self, experiment: Mapping, hyperparams: Mapping | None = None) -> int:
        """Append one experiment under the next id, and its hyperparameters as rows."""
        last = self.experiments().agg(F.max("id")).first()[0]
        new_id = 1 if last is None else last + 1
        row = {f.name: experiment.get(f.name) for f in S.EXPERIMENTS.fields}
        row.update(id=new_id, finished=row["finished"] or datetime.now())
        self.spark.createDataFrame([row], S.EXPERIMENTS).write.mode("append").parquet(f"{self.path}/experiments")
        pairs = [(new_id, n, str(v)) for n, v in (hyperparams or {}).items() if n not in NOT_HYPERPARAMS]
        if pairs:
            self.spark.createDataFrame(pairs, S.HYPERPARAMS).write.mode("append").parquet(f"{self.path}/hyperparams")
        return new_id

    def finish(self, plan_id: int) -> None:
        self.spark.createDataFrame([(plan_id, datetime.now())], S.PLAN_EVENTS).write.mode("append").parquet(f"{self.path}/plan_events")

    def finish_frame(self, events: DataFrame) -> None:
        events.select(*[F.col(f.name).cast(f.dataType) for f in S.PLAN_EVENTS.fields]).write.mode("append").parquet(f"{self.path}/plan_events")

    def next_plan(self) -> dict | None:
        found = next_plan(self.plans()).first()
        return None if found is None else found.asDict()
