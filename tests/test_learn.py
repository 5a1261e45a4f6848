import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import learn
from tidepanel.operators.ledger import Ledger
from tidepanel.operators.learn import LearnerParams
from tidepanel.plans import training as T
from tidepanel.session import scratch_path

FAST = LearnerParams(iterations=4, depth=3, border_count=32, learning_rate=0.3, subsample=0.8)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(600):
        x, level = rng.random(), rng.choice("abc")
        hit = int(x + (0.3 if level == "a" else 0.0) + rng.random() * 0.4 > 1.0)
        data.append((i, 201801 + i % 4, None if i % 13 == 0 else x, float("nan") if i % 17 == 0 else rng.random(), level, hit))
    return spark.createDataFrame(data, "id int, p int, x double, noise double, level string, target int").cache()


@pytest.fixture(scope="module")
def task(rows):
    train, test = T.holdout_by_period(rows, "p", [201801, 201802, 201803], [201804])
    return T.Task(train, test, ("x", "noise", "level"), ("id",), categorical=("level",))


def test_training_with_nulls_and_levels(spark, task):
    trained = learn.gbt_train(task.train, task.features, "target", FAST, categorical=["level"])
    unseen = task.test.withColumn("level", F.lit("zz"))
    for table in (task.test, unseen):
        probs = [r.prob for r in trained.score(table, "id").collect()]
        assert len(probs) == table.count() and all(0 <= p <= 1 for p in probs)
    ranked = learn.importance_sorted(learn.feature_importance(trained, spark)).collect()
    assert ranked[0].feature == "x" and sum(r.importance for r in ranked) == pytest.approx(1.0)
    fewer = learn.gbt_train(task.train, task.features, "target", FAST, categorical=["level"], ignored=["x"])
    assert [r.feature for r in learn.feature_importance(fewer, spark).collect()] == ["noise", "level"]


def test_metrics_beat_guessing(task):
    found = T.train_eval(T.load_pool(task), FAST)
    assert found["auc_testing"] > 0.7 and found["auc_training"] > 0.7
    assert found["logloss_testing"] < 0.6931
    assert 0 < found["perfect_profit_ratio"] <= 1 and found["profit"] <= found["perfect_profit"]
    fixed = T.train_eval(T.load_pool(task), FAST, cutoff=0.025)
    assert fixed["cutoff"] == 0.025 and fixed["profit"] == fixed["profit_0025"]


def test_bagging_is_the_mean_and_can_be_stored(spark, task):
    bag = T.bagging(task.train, task.features, "target", FAST, n_models=2, categorical=["level"])
    mean = {r.id: r.prob for r in bag.score(task.test, "id").collect()}
    parts = [{r.id: r.prob for r in learn.Trained(bag.preparation, (m,)).score(task.test, "id").collect()} for m in bag.models]
    assert all(mean[i] == pytest.approx((parts[0][i] + parts[1][i]) / 2) for i in mean)
    path = scratch_path(spark, "models")
    bag.save(path)
    again = learn.load_trained(path)
    assert again.preparation.features == bag.preparation.features and again.preparation.largest_category == bag.preparation.largest_category
    assert {r.id: r.prob for r in again.score(task.test, "id").collect()} == pytest.approx(mean)


def test_models_of_a_bag_differ(task):
    bag = T.bagging(task.train, task.features, "target", learn.LearnerParams(iterations=3, depth=3), n_models=3, categorical=["level"])
    assert len({m.toDebugString for m in bag.models}) == 3
    with pytest.raises(ValueError, match="subsample"):
        T.bagging(task.train, task.features, "target", learn.LearnerParams(subsample=1.0), n_models=2)


def test_too_many_levels(spark):
    from tidepanel.operators.clean import check_levels

    df = spark.range(30).selectExpr("cast(id as string) as level")
    check_levels(df, ["level"], 30)
    with pytest.raises(ValueError, match="levels"):
        check_levels(df, ["level"], 29)


def test_cross_validation(rows):
    got = T.stratified_cv(rows, ["x", "noise"], "target", ["id"], FAST, folds=2, n_models=1).collect()
    assert sorted((r.sample, r.fold) for r in got) == [("test", 1), ("test", 2), ("train", 1), ("train", 2)]
    assert all(0.5 < r.auc <= 1 and 0 < r.profit_ratio <= 1 for r in got)


def test_stacking_to_delivery(spark, rows):
    models = ["m1", "m2"]
    scores = rows.select("id", F.explode(F.array(*map(F.lit, models))).alias("model"), F.coalesce("x", F.lit(0.5)).alias("prob"), F.col("target").alias("class"))
    trained, wide = T.stacking(scores.where((F.col("model") == "m1") | (F.col("id") > 50)), models, FAST, n_models=2)
    assert wide.count() == 600
    top = T.score_and_rank(trained, scores.drop("class"), models, n=20).collect()
    assert len(top) == 20 and [r.prob for r in top] == sorted((r.prob for r in top), reverse=True)


def test_tree_on_ternary_class(rows):
    named = rows.withColumn("c", F.when(F.col("target") == 0, "CONTINUA").when(F.col("id") % 2 == 0, "BAJA+1").otherwise("BAJA+2"))
    model = learn.tree_classify(named, ["x", "level"], "c", categorical=["level"], depth=3)
    guessed = {r.predicted for r in model.transform(named).select("predicted").distinct().collect()}
    assert guessed <= {"CONTINUA", "BAJA+1", "BAJA+2"} and "CONTINUA" in guessed and "Tree" in learn.tree_text(model)


def test_grid(task):
    got = T.grid_cv(task.train, ["x"], "target", depths=(1, 2), folds=2, params=FAST).collect()
    assert [r.depth for r in got] == [1, 2] and all(r.auc > 0.6 for r in got)


def test_sweep_stays_in_the_box_and_sorts(task):
    pool = T.load_pool(task)
    box = T.Box({"depth": (1, 3), "learning_rate": (0.01, 1.0), "cutoff": (0.01, 0.1)})
    found = T.param_sweep(pool, box, trials=2, base=FAST)
    assert [r["objective"] for r in found] == sorted((r["objective"] for r in found), reverse=True)
    for r in found:
        assert 1 <= r["hyperparams"]["depth"] <= 3 and 0.01 <= r["hyperparams"]["learning_rate"] <= 1 and r["cutoff"] == r["hyperparams"]["cutoff"]
    again = T.param_sweep(pool, box, trials=2, base=FAST)
    assert [r["hyperparams"] for r in again] == [r["hyperparams"] for r in found]


def test_plan_queue(spark, rows):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    plans = [(1, "201801, 201802", "201803"), (2, "201803", "201804")]
    ledger.add_plans(spark.createDataFrame(plans, "id int, train string, test string").withColumn("finished", F.lit(None)))

    def load(train_periods, test_periods):
        return T.Task(*T.holdout_by_period(rows, "p", train_periods, test_periods), ("x", "noise"), ("id",))

    assert T.plan_runner(ledger, load, FAST) == 2
    assert sorted((r.plan_id, r.train_periods) for r in ledger.experiments().collect()) == [(1, "201801, 201802"), (2, "201803")]
    assert T.plan_runner(ledger, load, FAST) == 0 and ledger.next_plan() is None


def test_node_ids_are_not_kept(spark):
    """Kept node ids give the same trees, for a stored table of them at each level."""
    estimator = learn.LearnerParams(iterations=2, depth=3, border_count=8).estimator("target")
    assert not estimator.getCacheNodeIds()
    rows = spark.range(200).selectExpr("id % 7 AS a", "id % 11 AS b", "CAST((id * 37) % 5 < 2 AS int) AS target")
    vectors = learn.prepare(rows, ["a", "b"]).apply(rows, "target")
    trees = [estimator.setCacheNodeIds(kept).fit(vectors).toDebugString.split("\n", 1)[1] for kept in (False, True)]
    assert trees[0] == trees[1]
