import math
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import ensemble, evaluate, profile, running


@pytest.fixture(scope="module", autouse=True)
def many_blocks(spark):
    """Without this, adaptive execution would merge the small blocks of a test into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def made(seed, n, hot=0.4):
    """Scores with a hot value that many rows share, and all grid points."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        prob = 0.05 if rng.random() < hot else rng.choice([rng.random() ** 4, rng.randint(0, 101) / 1000.0])
        rows.append((i, prob, int(rng.random() < 0.2), "big" if rng.random() < 0.9 else "small"))
    rows += [(n + k, k / 1000.0, k % 2, "big") for k in range(102)]
    return rows


@pytest.fixture(scope="module")
def data():
    return made(3, 700)


@pytest.fixture(scope="module")
def scores(spark, data):
    return spark.createDataFrame(data, "id int, prob double, class int, g string").repartition(5)


def profit(rows, cutoff, gain=11700):
    return sum(gain if c == 1 else -300 for _, p, c, _ in rows if p > cutoff)


def test_sweep_equals_every_cutoff_against_every_score(scores, data):
    got = {r.k: r for r in evaluate.cutoff_sweep(scores).collect()}
    assert sorted(got) == list(range(101))
    for k, r in got.items():
        assert r.cutoff == k / 1000.0
        assert r.profit == profit(data, k / 1000.0)
        assert r.n_above == sum(p > k / 1000.0 for _, p, _, _ in data)
    assert evaluate.profit_at_cutoff(scores, 0.025).first().profit == profit(data, 0.025) == got[25].profit
    assert evaluate.profit_default_cutoff(evaluate.cutoff_sweep(scores)).first().profit == profit(data, 0.025)


def test_missing_probability_passes_no_cutoff(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 1), (1.0, 1), (5.0, 0)], "prob double, class int")
    assert all((r.n_above, r.hits) == (2, 1) for r in evaluate.cutoff_sweep(df).collect())
    assert evaluate.profit_at_cutoff(df, 0.0).first().profit == 11400


def test_sweep_per_group(scores, data):
    for r in evaluate.cutoff_sweep(scores, by=["g"], gain=11000).collect():
        assert r.profit == profit([d for d in data if d[3] == r.g], r.cutoff, 11000)


def test_best_cutoff_ties(spark):
    sweep = spark.createDataFrame([(k / 1000.0, 5 if k in (3, 7, 9) else 1) for k in range(12)], "cutoff double, profit bigint")
    assert evaluate.best_cutoff(sweep, "min").first().cutoff == 0.003
    assert evaluate.best_cutoff(sweep, "max").first().cutoff == 0.009
    assert sorted(r.cutoff for r in evaluate.best_cutoff(sweep, "all").collect()) == [0.003, 0.007, 0.009]


def curve_by_hand(rows):
    total, out = 0, []
    for rank, (i, p, c, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += 11700 if c == 1 else -300
        out.append((i, rank, total))
    return out


def test_curve_and_peak(scores, data):
    curve = evaluate.profit_curve(scores)
    expected = curve_by_hand(data)
    assert sorted((r.id, r.rank, r.profit_acum) for r in curve.collect()) == sorted(expected)
    top = max(t for _, _, t in expected)
    first = min(rank for _, rank, t in expected if t == top)
    peak = evaluate.profit_curve_peak(curve).first()
    assert (peak["rank"], peak.profit_acum) == (first, top)
    at = evaluate.counts_at_best(curve).first()
    above = [d for d in data if d[1] >= peak.prob]
    assert (at.n, at.hits, at.misses) == (len(above), sum(d[2] for d in above), sum(1 - d[2] for d in above))
    band = evaluate.prob_in_profit_band(curve, 100_000, 200_000).first()
    inside = [i for i, _, t in expected if 100_000 <= t <= 200_000]
    assert band.n == len(inside) and band.cutoff == pytest.approx(sum(data[i][1] for i in inside) / len(inside))


def test_curve_per_group(scores, data):
    got = evaluate.profit_curve(scores, by=["g"]).collect()
    for g in ("big", "small"):
        assert sorted((r.id, r.rank, r.profit_acum) for r in got if r.g == g) == sorted(curve_by_hand([d for d in data if d[3] == g]))


def area(rows):
    pos, neg = [r[1] for r in rows if r[2] == 1], [r[1] for r in rows if r[2] == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_all_pairs(scores, data):
    assert evaluate.auc(scores).first().auc == pytest.approx(area(data), abs=1e-12)
    for r in evaluate.auc(scores, by=["g"]).collect():
        assert r.auc == pytest.approx(area([d for d in data if d[3] == r.g]), abs=1e-12)


def test_auc_equals_spark_evaluator_without_binning(scores):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    raw = scores.select(array_to_vector(F.array(1 - F.col("prob"), F.col("prob"))).alias("raw"), F.col("class").cast("double").alias("y"))
    exact = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", numBins=0).evaluate(raw)
    assert evaluate.auc(scores).first().auc == pytest.approx(exact, abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    assert evaluate.auc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "prob double, class int")).first().auc is None


def test_logloss(spark):
    df = spark.createDataFrame([(0.5, 1), (0.25, 0), (1.0, 1), (0.0, 0)], "prob double, class int")
    expected = (-math.log(0.5) - math.log(0.75)) / 4
    assert evaluate.logloss(df).first().logloss == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_totals_split_a_hot_group(spark, partitions):
    """One group holds most rows, one key is null, and sums run over more blocks than one."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 8 + ["cold", None]), rng.randint(-5, 5)) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "id int, g string, v int")
        got = running.running_totals(df, [F.col("id").asc()], {"s": F.col("v")}, {"m": F.col("v")}, by=["g"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen, expected = {}, []
    for i, g, v in rows:
        s, m = seen.get(g, (0, -99))
        seen[g] = (s + v, max(m, v))
        expected.append((i, g, v, *seen[g]))
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == expected


def test_hot_group_is_spread_over_blocks(spark):
    df = spark.range(20000).select("id", F.lit("hot").alias("g"))
    plan = running.numbered(df, [F.col("id").asc()], by=["g"])
    assert plan.where(F.col("rank") != F.col("id") + 1).count() == 0
    blocks = df.repartitionByRange("g", "id").select(F.spark_partition_id().alias("b")).distinct().count()
    assert blocks > 1


def test_folds_are_balanced_and_complete(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(1003)]
    folds = ensemble.stratified_folds(spark.createDataFrame(rows, "id int, class int"), "class", "id", 10).collect()
    assert sorted(r.id for r in folds) == list(range(1003))
    sizes = {}
    for r in folds:
        sizes[(r["class"], r.fold)] = sizes.get((r["class"], r.fold), 0) + 1
    for c in (0, 1):
        of_class = [sizes[(c, f)] for f in range(1, 11)]
        assert max(of_class) - min(of_class) <= 1
    train, test = ensemble.fold_split(spark.createDataFrame(folds), 3)
    assert train.count() + test.count() == 1003 and {r.fold for r in test.collect()} == {3}


def test_resampling_sizes(spark):
    df = spark.createDataFrame([(i, "CONTINUA" if i % 20 else "BAJA+2") for i in range(400)], "id int, c string")
    down = ensemble.downsample_majority(df, "c", "CONTINUA", "id").groupBy("c").count().collect()
    assert {r.c: r["count"] for r in down} == {"CONTINUA": 30, "BAJA+2": 20}
    up = ensemble.oversample_minority(df, "c", "BAJA+2", "id", times=50)
    assert {r.c: r["count"] for r in up.groupBy("c").count().collect()} == {"CONTINUA": 380, "BAJA+2": 20 + 50 * 20}
    everything = ensemble.downsample_majority(df, "c", "CONTINUA", "id", ratio=100)
    assert everything.count() == 400


def test_quantiles_of_a_hot_value(spark):
    rows = [("a", 5)] * 300 + [("a", v) for v in range(100)] + [("b", v) for v in (1, 2, 3, 10)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    wanted = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    expected = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in wanted.items()]).collect()}
    for r in profile.exact_quantiles(df, "v", wanted, ["g"]).collect():
        assert all(r[n] == expected[r.g][n] for n in wanted)
    assert profile.exact_quantiles(df, "v", {"top": 1.0}).first().top == 99
    boxes = {r.g: r for r in profile.box_stats(df, "v", "g").collect()}
    assert (boxes["b"].n, boxes["b"].whisker_low, boxes["b"].whisker_high, boxes["b"].n_outliers) == (4, 1, 3, 1)
    assert [r.v for r in profile.box_outliers(df, "v", "g").collect() if r.g == "b"] == [10]


def test_ensemble_keeps_ids_of_any_model(spark):
    rows = [(1, "x", 0.1, 0), (2, "x", 0.2, 1), (2, "y", 0.4, 0), (3, "y", 0.6, 1)]
    scores = spark.createDataFrame(rows, "id int, model string, prob double, class int")
    wide = {r.id: r for r in ensemble.ensemble_full_join(scores, ["x", "y"]).collect()}
    assert sorted(wide) == [1, 2, 3] and wide[3].prob_model_x is None and wide[3].prob_model_y == 0.6 and wide[2]["class"] == 1
    check = ensemble.ensemble_key_check(scores, ["x", "y"]).first()
    assert (check.model, check.n_key_diff, check.n_class_diff) == ("y", 2, 1)


def test_missing_scores_and_labels_are_passed_over(spark):
    rows = [(1, 0.9, 1), (2, 0.2, 0), (3, None, 1), (4, float("nan"), 0), (5, 0.4, None)]
    df = spark.createDataFrame(rows, "id int, prob double, class int")
    want = -(math.log(0.9) + math.log(0.8)) / 2
    assert evaluate.logloss(df).first()["logloss"] == pytest.approx(want)
    assert evaluate.auc(df).first()["n"] == 2
    assert [r.id for r in ensemble.top_n_ids(df, 3).collect()] == [1, 5, 2]
    assert {r.id: r["rank"] for r in ensemble.rank_ids(df).collect()} == {1: 1, 5: 2, 2: 3, 3: 4, 4: 5}
    assert [r.id for r in evaluate.profit_curve(df).orderBy("rank").collect()][:3] == [1, 5, 2]
