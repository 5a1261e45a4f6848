"""Symmetric trees against a plain booster that knows nothing of bins' sums or passes."""

import math
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import boost, evaluate
from tidepanel.operators.boost import BoostParams, Model
from tidepanel.plans import boosting
from tidepanel.plans.training import Box, Task

FAST = BoostParams(iterations=4, depth=3, border_count=7, learning_rate=0.3, random_strength=0.0)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    rows = []
    for i in range(500):
        x, z = rng.random(), rng.choice((None, 1.0, 2.0, 3.0))
        hit = int(x + (0.3 if z is None else 0.05 * z) + rng.random() * 0.4 > 1.0)
        rows.append((i, 201801 + i % 4, None if i % 13 == 0 else x, float("nan") if i % 17 == 0 else rng.random(), z, None if i % 101 == 7 else hit))
    return rows


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "id int, p int, x double, noise double, z double, target int").repartition(3).cache()


def plain_train(bins, label, row, params, trees, keep=None):
    """Row by row in Python: the raw scores after ``trees`` trees and the splits."""
    n, width, raw, splits = len(bins), len(bins[0]), [0.0] * len(bins), []
    for tree in range(trees):
        weight = [(-math.log(boost.uniform(np.array([r]), params.seed, tree)[0])) ** params.bagging_temperature for r in row]
        if keep is not None:
            weight = [w * k for w, k in zip(weight, keep)]
        p = [1 / (1 + math.exp(-v)) for v in raw]
        g = [math.floor((y - q) * w * boost.UNIT + 0.5) for y, q, w in zip(label, p, weight)]
        h = [math.floor(q * (1 - q) * w * boost.UNIT + 0.5) for q, w in zip(p, weight)]
        leaf, chosen = [0] * n, []
        for level in range(params.depth):
            best = None
            for f in range(width):
                for t in range(1, max(b[f] for b in bins) + 1):
                    sums = {}
                    for k in range(n):
                        s = sums.setdefault((leaf[k], bins[k][f] >= t), [0, 0])
                        s[0] += g[k]
                        s[1] += h[k]
                    score = sum((a / boost.UNIT) ** 2 / (b / boost.UNIT + params.l2_leaf_reg) for a, b in sums.values())
                    if best is None or score > best[0] + 1e-12:
                        best = (score, f, t)
            chosen.append(best[1:])
            leaf = [v | (int(b[best[1]] >= best[2]) << level) for v, b in zip(leaf, bins)]
        for v in set(leaf):
            gs, hs = (sum(x[k] for k in range(n) if leaf[k] == v) / boost.UNIT for x in (g, h))
            value = params.learning_rate * gs / (hs + params.l2_leaf_reg)
            raw = [r + value if own == v else r for r, own in zip(raw, leaf)]
        splits.append(chosen)
    return raw, splits


def test_bins(spark, rows, data):
    binning = boost.learn_bins(rows, ["x", "z"], 3)
    known = sorted(r[2] for r in data if r[2] is not None)
    assert binning.borders[0] == tuple(known[math.ceil(k * len(known) / 4) - 1] for k in (1, 2, 3)) and binning.borders[1] == (2.0, 3.0)
    got = {r["id"]: list(r["bins"]) for r in binning.apply(rows, "id").collect()}
    for i, _, x, _, z, _ in data:
        want = 0 if x is None else 1 + sum(b <= x for b in binning.borders[0])
        assert got[i] == [want, {None: 0, 1.0: 1, 2.0: 2, 3.0: 3}[z]]
    assert boost.learn_bins(rows.where("id < 0"), ["x"], 3).borders == ((),)
    with pytest.raises(ValueError, match="border_count"):
        boost.learn_bins(rows, ["x"], 255)


def test_equals_plain_trees(spark, rows):
    binning = boost.learn_bins(rows, ["x", "noise", "z"], FAST.border_count)
    binned = boost.train_rows(binning, rows, "target", F.col("id"), "p", keep=("id",))
    local = sorted(binned.collect(), key=lambda r: r["id"])
    bins, label, row = [list(r["bins"]) for r in local], [r["label"] for r in local], [r["row"] for r in local]
    models = [Model(FAST), Model(replace(FAST, seed=5, depth=2, iterations=3, l2_leaf_reg=0.5)), Model(replace(FAST, iterations=3), held_out=201802)]
    forest = boost.train_models(binned.drop("id"), binning, models)
    for (params, held_out), trees in zip(models, forest.trees):
        keep = None if held_out is None else [float(r["fold"] != held_out) for r in local]
        raw, splits = plain_train(bins, label, row, params, params.iterations, keep)
        assert [list(zip(f, t)) for f, t in zip(trees.features, trees.bins)] == splits
        assert boost.added(np.array(bins, np.uint8), trees) == pytest.approx(np.array(raw), abs=1e-9)


def _batch(n=400, width=3, n_models=6):
    rng = np.random.default_rng(2)
    columns = {
        "bins": [r.tobytes() for r in rng.integers(0, 9, (n, width), dtype=np.uint8)], "raw": [r.tobytes() for r in rng.normal(size=(n, n_models))],
        "label": rng.integers(0, 2, n).astype(float), "row": rng.integers(0, 1 << 28, n), "fold": rng.integers(1, 4, n).astype(np.int32),
    }
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def test_models_of_a_seed_draw_row_weights_once(monkeypatch):
    """Six models of two seeds and three folds: two draws a batch, not six; and sums do not depend on the order of the rows' leaves."""
    batch, drawn, uniform = _batch(), [], boost.uniform
    monkeypatch.setattr(boost, "uniform", lambda row, seed, tree: drawn.append(seed) or uniform(row, seed, tree))
    models = {m: Model(replace(FAST, seed=1 + m % 2), held_out=1 + m // 2) for m in range(6)}
    pending = {m: boost.Trees([[0, 1]], [[2, 5]], [np.array([0.1, -0.2, 0.3, -0.4])]) for m in models}
    found = []
    for near in (1, 1 << 20):
        monkeypatch.setattr(boost, "NEAR_SUMS", near, raising=False)
        run = boost._level_sums(models, pending, {m: ([m % 3, 1], [4, 3]) for m in models}, 1, 3, 9, 6)
        found.append([b.column("sums").to_pylist() for b in run(iter([batch.slice(0, 150), batch.slice(150)]))])
    assert sorted(drawn) == [1] * 4 + [2] * 4 and found[0] == found[1] and len(found[0]) == 6


def test_matrix_of_a_slice():
    rows = [bytes([i, i + 1]) for i in range(10)]
    assert boost.matrix(pa.array(rows).slice(3, 4), "u1", 2).tolist() == [list(r) for r in rows[3:7]]
    assert boost.matrix(pa.array([], pa.binary()), "u1", 2).shape == (0, 2)


def test_passes_do_not_grow_with_models(spark, rows, monkeypatch):
    binning = boost.learn_bins(rows, ["x", "noise"], 15)
    binned = boost.train_rows(binning, rows, "target", F.col("id"), "p").cache()
    counted = []
    calls = type(binned).collect

    def collect(self):
        counted[-1] += 1
        return calls(self)

    monkeypatch.setattr(type(binned), "collect", collect)
    forests = []
    for n in (1, 12):
        counted.append(0)
        forests.append(boost.train_models(binned, binning, [Model(replace(FAST, seed=s, random_strength=1.0)) for s in range(1, n + 1)]))
    # One question for the fold sizes and one for each level of each tree.
    assert counted == [1 + FAST.iterations * FAST.depth] * 2
    # A model is the same alone and among others, and where the sums of few models fit at once.
    same = lambda a, b: a.features == b.features and a.bins == b.bins and all((x == y).all() for x, y in zip(a.values, b.values))
    assert same(forests[0].trees[0], forests[1].trees[0]) and not same(forests[1].trees[0], forests[1].trees[1])
    monkeypatch.setattr(boost, "TASK_BYTES", 4000)
    monkeypatch.setattr(boost, "MEET_BYTES", 1000)
    again = boost.train_models(binned.repartition(5), binning, forests[1].models)
    assert all(same(a, b) for a, b in zip(forests[1].trees, again.trees))


def test_settings_matter(rows):
    binning = boost.learn_bins(rows, ["x", "noise", "z"], 31)
    binned = boost.train_rows(binning, rows, "target", F.col("id"))
    changes = [{}, {"l2_leaf_reg": 1000.0}, {"random_strength": 50.0}, {"bagging_temperature": 0.0}, {"learning_rate": 0.0}]
    forest = boost.train_models(binned, binning, [Model(replace(FAST, **c)) for c in changes])
    plain, shrunk, noisy, unweighted, still = forest.trees
    assert max(map(np.abs, plain.values[0])) > 5 * max(map(np.abs, shrunk.values[0]))
    assert noisy.features != plain.features and not any((a == b).all() for a, b in zip(plain.values, unweighted.values))
    assert not np.concatenate(still.values).any()


def test_writes_between_trees_change_nothing(rows, monkeypatch):
    binning = boost.learn_bins(rows, ["x", "z"], 7)
    binned = boost.train_rows(binning, rows, "target", F.col("id"))
    found = []
    for every in (1, 3, 100):
        monkeypatch.setattr(boost, "WRITE_EVERY", every)
        found.append(boost.train_models(binned, binning, [Model(FAST)]).trees[0])
    for other in found[1:]:
        assert other.features == found[0].features and all(a == pytest.approx(b) for a, b in zip(other.values, found[0].values))


@pytest.fixture(scope="module")
def task(rows):
    return Task(rows.where("p < 201804"), rows.where("p = 201804"), ("x", "noise", "z"), ("id",))


def test_beats_the_prior(task):
    found = boosting.train_eval(task, replace(FAST, iterations=20))
    share = task.test.agg(F.avg("target")).first()[0]
    prior = -(share * math.log(share) + (1 - share) * math.log(1 - share))
    assert found["logloss_testing"] < 0.8 * prior and found["auc_testing"] > 0.85 and 0 < found["perfect_profit_ratio"] <= 1


def test_staged_equals_shorter_trainings(task):
    params = replace(FAST, iterations=6, random_strength=1.0)
    forest = boosting.bagging(task.train, task.features, task.label, task.id, params, 1)
    staged = {r["trees"]: r for r in boosting.staged_metrics(forest, task.test, task.label).collect()}
    assert sorted(staged) == [1, 2, 3, 4, 5, 6]
    for n in (1, 3, 6):
        short = boosting.bagging(task.train, task.features, task.label, task.id, replace(params, iterations=n), 1)
        scores = short.score(task.test.where("target IS NOT NULL").withColumnRenamed("target", "class"), "id", "class")
        best = evaluate.best_cutoff(evaluate.cutoff_sweep(scores), "max").first()
        assert (staged[n]["profit"], staged[n]["cutoff"]) == (best["profit"], best["cutoff"])
        assert staged[n]["profit_0025"] == evaluate.profit_default_cutoff(evaluate.cutoff_sweep(scores)).first()["profit"]
        assert staged[n]["logloss"] == pytest.approx(evaluate.logloss(scores).first()["logloss"])


def test_bag_and_repeats(task):
    bag = boosting.bagging(task.train, task.features, task.label, task.id, FAST, 3)
    mean = {r["id"]: r["prob"] for r in bag.score(task.test, "id").collect()}
    parts = [{r["id"]: r["prob"] for r in bag.score(task.test, "id", models=[m]).collect()} for m in range(3)]
    assert mean == pytest.approx({i: sum(p[i] for p in parts) / 3 for i in mean}) and parts[0] != parts[1]
    three = boosting.repeat_trial(task, FAST, 3)
    assert 0.5 < three["auc_testing"] <= 1 and "minutes_taken" in three
    with pytest.raises(ValueError, match="seed"):
        boosting.bagging(task.train, task.features, task.label, task.id, replace(FAST, bagging_temperature=0.0), 2)


def test_cross_validation_holds_out(rows):
    got = boosting.stratified_cv(rows, ["x", "noise", "z"], "target", ["id"], replace(FAST, depth=2), folds=3, n_models=2).collect()
    assert sorted((r["sample"], r["fold"]) for r in got) == [(s, i) for s in ("test", "train") for i in (1, 2, 3)]
    assert all(0.7 < r["auc"] <= 1 and 0 < r["profit_ratio"] <= 1 for r in got)
    # A label without any pattern is only learnt where it was seen.
    coin = rows.withColumn("target", (F.xxhash64("id") % 2 == 0).cast("int"))
    means = {}
    for r in boosting.stratified_cv(coin, ["x", "noise"], "target", ["id"], replace(FAST, depth=4, border_count=31, iterations=8), folds=3, n_models=2).collect():
        means.setdefault(r["sample"], []).append(r["auc"])
    assert min(means["train"]) > 0.65 and np.mean(means["test"]) < 0.6


def test_grid(rows):
    got = {r["depth"]: r for r in boosting.grid_cv(rows, ["x", "z"], "target", ["id"], depths=(1, 2), folds=2, params=FAST).collect()}
    assert sorted(got) == [1, 2] and all(r["auc"] > 0.8 for r in got.values())


def test_stacking_to_delivery(spark, rows):
    models = ["m1", "m2"]
    scores = rows.select("id", F.explode(F.array(*map(F.lit, models))).alias("model"), F.coalesce("x", F.lit(0.5)).alias("prob"), F.coalesce("target", F.lit(0)).alias("class"))
    forest, wide = boosting.stacking(scores.where((F.col("model") == "m1") | (F.col("id") > 50)), models, FAST, n_models=2)
    assert wide.count() == 500
    top = boosting.score_and_rank(forest, scores.drop("class"), models, n=20).collect()
    assert len(top) == 20 and [r["prob"] for r in top] == sorted((r["prob"] for r in top), reverse=True)


def test_sweep_grows_all_points_at_once(task):
    box = Box({"depth": (1, 3), "learning_rate": (0.01, 1.0), "l2_leaf_reg": (1, 10), "cutoff": (0.01, 0.1)})
    found = boosting.param_sweep(task, box, trials=4, base=FAST)
    assert [r["objective"] for r in found] == sorted((r["objective"] for r in found), reverse=True) and {r["trial"] for r in found} == {1, 2, 3, 4}
    for r in found[:2]:
        point = {k: v for k, v in r["hyperparams"].items() if k != "cutoff"}
        alone = boosting.train_eval(task, replace(FAST, **point), cutoff=r["hyperparams"]["cutoff"])
        assert (r["profit"], r["auc_testing"], r["logloss_testing"]) == (alone["profit"], alone["auc_testing"], alone["logloss_testing"])
        assert r["objective"] == alone["perfect_profit_ratio"] and r["cutoff"] == pytest.approx(r["hyperparams"]["cutoff"], abs=1e-5)
    free = boosting.param_sweep(task, Box({"depth": (1, 3)}), trials=2, base=replace(FAST, random_strength=1.0), repeats=2)
    assert all(0 < r["objective"] <= 1 for r in free)
    with pytest.raises(ValueError, match="border_count"):
        boosting.param_sweep(task, Box({"border_count": (8, 64)}), trials=1)


def test_registered_sweep_is_of_the_whole_box(spark, monkeypatch):
    from tidepanel.catalog import learning

    trained = []

    def train(rows, binning, models):
        trained.extend(m.params for m in models)
        raise InterruptedError

    monkeypatch.setattr(boosting, "train_models", train)
    with pytest.raises(InterruptedError):
        learning.param_sweep_(spark, "/root/testdata/sf0.001")
    assert len(trained) == 200
    for name in ("depth", "iterations"):
        low, high = boosting.CUTOFF_BOX.bounds[name]
        found = [getattr(p, name) for p in trained]
        assert low <= min(found) < low + 0.1 * (high - low) + 1 and high - 0.1 * (high - low) - 1 < max(found) <= high


def test_smaller_sides_give_the_same_trees(spark, rows, monkeypatch):
    """The sums of a split leaf's heavier side are those before it without the lighter side's, for unlike depths, folds and turns too."""
    binning = boost.learn_bins(rows, ["x", "noise", "z"], 15)
    binned = boost.train_rows(binning, rows, "target", F.col("id"), "p").cache()
    models = [Model(replace(FAST, seed=s, depth=d, random_strength=1.0), held_out=h) for s, d, h in ((1, 4, None), (2, 1, 201801), (3, 3, 201802), (4, 5, None))]
    looked_at, bincount = [], np.bincount
    whole = boost.train_models(binned, binning, models)
    monkeypatch.setattr(boost, "HALVED_SUMS", 0)
    monkeypatch.setattr(boost, "TASK_BYTES", 20_000)
    halved = boost.train_models(binned.repartition(5), binning, models)
    for a, b in zip(whole.trees, halved.trees):
        assert a.features == b.features and a.bins == b.bins and all((x == y).all() for x, y in zip(a.values, b.values))
    monkeypatch.setattr(np, "bincount", lambda cell, *rest: looked_at.append(len(cell)) or bincount(cell, *rest))
    sides = np.array([1], np.uint8)
    run = boost._level_sums({0: Model(FAST)}, {0: boost.Trees([], [], [])}, {0: ([0], [4])}, 0, 3, 9, 6, {0: sides})
    batch = _batch()
    list(run(iter([batch])))
    assert looked_at == [int((boost.bins_matrix(batch.column("bins"), 3)[:, 0] >= 4).sum())] * 6


def test_training_reads_blocks(rows, monkeypatch):
    """A level reads a row per block, and writes no scores of shallow trees."""
    binning, read, written = boost.learn_bins(rows, ["x", "z"], 7), [], []
    binned = boost.train_rows(binning, rows, "target", F.col("id")).coalesce(2)
    pinned = boost.pinned
    monkeypatch.setattr(boost, "pinned", lambda df: written.append(pinned(df)) or written[-1])
    monkeypatch.setattr(boost, "WRITE_EVERY", 1)
    boost.train_models(binned, binning, [Model(replace(FAST, depth=2))])
    read.append([df.count() for df in written])
    written.clear()
    boost.train_models(binned, binning, [Model(replace(FAST, depth=4))])
    read.append([df.count() for df in written])
    assert read == [[2], [2] * (1 + FAST.iterations)]


def test_joined_trees_add_the_same():
    rng = np.random.default_rng(3)
    bins = boost.by_feature(rng.integers(0, 9, (200, 3), dtype=np.uint8))
    split = lambda high, n: [int(v) for v in rng.integers(0 if high == 3 else 1, high, n)]
    depths = (2, 3, 3, 1, 9, 4, 4, 2, 0)
    trees = boost.Trees([split(3, d) for d in depths], [split(9, d) for d in depths], [rng.normal(size=1 << d) for d in depths])
    joined = boost.joined(trees)
    assert [len(f) for f in joined.features] == [8, 1, 9, 8, 2] and [len(f) for f in trees.features] == list(depths)
    want = sum(v[[sum(int(row[f] >= t) << k for k, (f, t) in enumerate(zip(fs, ts))) for row in bins]] for fs, ts, v in zip(*trees))
    assert boost.added(bins, joined) == pytest.approx(want) and boost.added(bins, trees) == pytest.approx(want)
