"""Association trees against plain counting and known tails of the chi-square distribution."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import association as A


@pytest.mark.parametrize("x", [0.01, 0.5, 1.0, 3.84, 10.0, 50.0, 400.0, 5000.0])
def test_tails(x):
    assert A.log_upper_chi_square(x, 1) == pytest.approx(math.log(math.erfc(math.sqrt(x / 2))) if x < 1000 else A.log_upper_chi_square(x, 1), rel=1e-9)
    for half in (1, 2, 5, 9):
        # With an even number of degrees the tail is a short sum.
        log_sum = math.log(sum((x / 2) ** i / math.factorial(i) for i in range(half)))
        assert A.log_upper_chi_square(x, 2 * half) == pytest.approx(log_sum - x / 2, rel=1e-9, abs=1e-12)
    assert A.log_upper_chi_square(0.0, 3) == 0.0


def test_statistic():
    table = np.array([[10, 20, 30], [0, 0, 0], [15, 5, 10]])
    n, want = table.sum(), 0.0
    for r in (0, 2):
        for c in range(3):
            e = table[r].sum() * table[:, c].sum() / n
            want += (table[r, c] - e) ** 2 / e
    assert A.chi_square(table) == (pytest.approx(want), 2)
    assert A.chi_square(np.array([[3, 4]])) == (0.0, 0) and A.chi_square(np.array([[3, 0], [4, 0]])) == (0.0, 0)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        x, z, many = rng.random(), rng.choice((None, 1.0, 2.0)), rng.random()
        c = "A" if x < 0.4 else "B" if z == 1.0 else "C"
        rows.append((i, None if i % 19 == 0 else x, z, many, None if i % 97 == 3 else c if rng.random() < 0.9 else rng.choice("ABC")))
    return rows


def test_tree(spark, data):
    df = spark.createDataFrame(data, "id int, x double, z double, many double, c string").repartition(5)
    tree = A.association_tree(df, ["many", "x", "z"], "c", depth=3, bins=8)
    root = tree.nodes[0]
    assert tree.classes == ("A", "B", "C") and sum(root.counts) == sum(r[4] is not None for r in data)
    assert tree.binning.features[root.feature] == "x" and root.log_p < -100
    # Noise is never chosen, and the tree stops before the depth it may have.
    used = {tree.binning.features[n.feature] for n in tree.nodes.values() if n.feature is not None}
    assert used <= {"x", "z"} and "z" in used
    for i, n in tree.nodes.items():
        if n.feature is not None:
            assert tuple(np.add(tree.nodes[2 * i + 1].counts, tree.nodes[2 * i + 2].counts)) == n.counts
    got = tree.classify(df.withColumn("other", F.lit("kept")), "id", "c", "other").collect()
    assert len(got) == len(data) and {r["other"] for r in got} == {"kept"}
    assert sum(r["c"] == r["predicted"] for r in got) / len(got) > 0.8
    by_leaf = {}
    for r in got:
        if r["c"] is not None:
            by_leaf.setdefault(r["node"], []).append(r["c"])
    for leaf, members in by_leaf.items():
        assert tuple(members.count(c) for c in "ABC") == tree.nodes[leaf].counts
    table = tree.table(spark).collect()
    assert [r["node"] for r in table] == sorted(tree.nodes) and table[0]["feature"] == "x"


def test_first_split_by_hand(spark, data):
    rows = [r for r in data if r[4] is not None]
    df = spark.createDataFrame(rows, "id int, x double, z double, many double, c string")
    tree = A.association_tree(df, ["x"], "c", depth=1, bins=4)
    bins = {r["id"]: r["bins"][0] for r in tree.binning.apply(df, "id").collect()}
    best = None
    for t in range(2, tree.binning.n_bins):
        table = [[sum(r[4] == c and bins[r[0]] > 0 and (bins[r[0]] >= t) == side for r in rows) for c in "ABC"] for side in (False, True)]
        n = sum(map(sum, table))
        stat = n * (sum(v * v / (sum(row) * sum(other[k] for other in table)) for row in table for k, v in enumerate(row)) - 1)
        best = max(best or (stat, t), (stat, t), key=lambda b: b[0])
    assert tree.nodes[0].threshold == best[1]
    sides = [sum(0 < bins[r[0]] < best[1] for r in rows), sum(bins[r[0]] >= best[1] for r in rows)]
    missing = sum(bins[r[0]] == 0 for r in rows)
    assert [sum(tree.nodes[k].counts) for k in (1, 2)] == [sides[0] + missing * (sides[0] >= sides[1]), sides[1] + missing * (sides[1] > sides[0])]


def test_nothing_to_split(spark):
    same = spark.createDataFrame([(i, float(i % 5), "A") for i in range(50)], "id int, x double, c string")
    assert list(A.association_tree(same, ["x"], "c").nodes) == [0]
    few = spark.createDataFrame([(i, float(i % 2), "AB"[i % 2]) for i in range(12)], "id int, x double, c string")
    assert list(A.association_tree(few, ["x"], "c").nodes) == [0] and list(A.association_tree(few, ["x"], "c", min_split=10, min_leaf=3).nodes) == [0, 1, 2]
    empty = A.association_tree(few.where("id < 0"), ["x"], "c")
    assert empty.nodes == {} and empty.classes == ()
    coin = random.Random(5)
    noise = spark.createDataFrame([(i, coin.random(), coin.choice("ABC")) for i in range(2000)], "id int, x double, c string")
    assert list(A.association_tree(noise, ["x"], "c", alpha=0.001).nodes) == [0]
