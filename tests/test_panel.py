import random

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.periods import backward_month_list
from tidepanel.operators import panel

# key, period, x: a full key with a year end, one with an inner gap, one only current, one gone.
ROWS = [
    (1, 201711, 2.0), (1, 201712, 4.0), (1, 201801, 4.0), (1, 201802, 10.0),
    (2, 201711, 5.0), (2, 201801, None), (2, 201802, 7.0),
    (3, 201802, 1.0),
    (4, 201711, 9.0), (4, 201712, 9.0),
    (5, 201711, 3.0), (5, 201712, 3.0), (5, 201801, 3.0), (5, 201802, 3.0),
    (6, 201712, float("nan")), (6, 201801, 0.0), (6, 201802, 6.0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k int, p int, x double")


def lags(df, **options):
    made = panel.panel_lags(df, "k", "p", ["x"], **options)
    return {(r.k, r.p): (r.x__y0, r.x__y1, r.x__y2, r.x__y3) for r in made.collect()}


def test_lags_by_hand(rows):
    got = lags(rows, periods=[201802])
    assert got == {
        (1, 201802): (2, 4, 4, 10), (2, 201802): (5, 0, 0, 7), (3, 201802): (0, 0, 0, 1),
        (5, 201802): (3, 3, 3, 3), (6, 201802): (0, 0, 0, 6),
    }


def test_all_periods_in_one_pass_equal_each_alone(rows):
    together = lags(rows, periods=[201802, 201712])
    alone = {**lags(rows, periods=[201802]), **lags(rows, periods=[201712])}
    assert together == alone == {k: v for k, v in lags(rows).items() if k[1] in (201802, 201712)}


def test_interpolated_gaps(rows):
    got = lags(rows, periods=[201802], fill="interpolate")
    assert got[(2, 201802)] == (5, None, None, 7)
    assert got[(3, 201802)] == (0, None, None, 1)
    assert got[(6, 201802)] == (0, 0, 0, 6)


def test_features_by_hand(rows):
    spec = panel.PanelSpec("k", "p", ("x",), max_min=True, category_findiff=True, salary="x")
    got = {r.k: r for r in panel.panel_features(rows, spec, [201802]).collect()}
    one, constant, zero_before = got[1], got[5], got[3]
    assert (one["x__MAX"], one["x__MIN"]) == (10, 2)
    assert one["x__CREC_POLI"] == (-2 * 2 + 9 * 4 - 18 * 4 + 11 * 10) / 6 * 8
    assert one["x__CREC_DIFINI"] == (4 - 4 * 4 + 3 * 2) / 2 * 8
    assert one["x__ACEL_POLI"] == (-2 + 4 * 4 - 5 * 4 + 2 * 10) / 8
    assert one["x__ACEL_DIFINI"] == (-10 + 4 * 4 - 5 * 4 + 2 * 2) / 8
    assert (one["x__ACEL_POLI__CAT_POLI"], one["x__CREC_DIFINI__CAT_DIFINI"], one["x__ANDREU"]) == (1, -1, -1.5)
    assert constant["x__CREC_POLI"] == 0 and constant["x__ACEL_POLI"] is None and constant["x__ACEL_POLI__CAT_POLI"] is None
    assert zero_before["x__ANDREU"] is None and zero_before["dependencia_salarial"] == 1


def test_flags_choose_columns(rows):
    off = panel.without_history(panel.PanelSpec("k", "p", ("x",)))
    assert panel.panel_features(rows, off, [201802]).columns == ["k", "p", "x"]
    only = panel.PanelSpec("k", "p", ("x",), growth_findiff=False, accel_findiff=False, accel_poly=False, trend_relative=False)
    assert panel.panel_features(rows, only).columns == ["k", "p", "x", "x__CREC_POLI"]


def test_one_shuffle_for_all_periods_and_lags(rows):
    spec = panel.PanelSpec("k", "p", ("x",), max_min=True)
    plan = panel.panel_features(rows, spec, [201802, 201712])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort") + plan.count("- *(2) Sort") + plan.count("Sort [") >= 1


def test_random_panel_against_brute_force(spark):
    rng = random.Random(5)
    months = backward_month_list(201806, 29)
    data = {(k, p): float(rng.randint(-50, 50)) for k in range(20) for p in months if rng.random() < 0.6}
    df = spark.createDataFrame([(k, p, v) for (k, p), v in data.items()], "k int, p int, x double")
    expected = {(k, p): tuple(data.get((k, q), 0.0) for q in backward_month_list(p, 3)) for k, p in data}
    assert lags(df) == expected
    past = panel.history(df, "k", "p", "x", {"m": "avg", "top": "max"}, first=-6, last=-1)
    for r in past.collect():
        seen = [data[(r.k, q)] for q in backward_month_list(r.p, 6)[:-1] if (r.k, q) in data]
        assert r.top == (max(seen) if seen else None)
        assert r.m == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    fixed = panel.history(df, "k", "p", "x", {"m": "avg"}, since=201709, periods=[201803, 201804])
    for r in fixed.collect():
        seen = [v for (k, q), v in data.items() if k == r.k and 201709 < q < r.p]
        assert r.p in (201803, 201804) and r.m == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def test_open_window_has_five_months(spark):
    df = spark.createDataFrame([(1, p, float(i)) for i, p in enumerate(backward_month_list(201806, 7))], "k int, p int, x double")
    got = {r.p: r.m for r in panel.history_open(df, "k", "p", "x", {"m": "max"}).collect()}
    closed = {r.p: r.m for r in panel.history(df, "k", "p", "x", {"m": "avg"}).collect()}
    assert got[201806] == 6.0 and closed[201806] == (1 + 2 + 3 + 4 + 5 + 6) / 6
    five = {r.p: r.m for r in panel.history_open(df, "k", "p", "x", {"m": "avg"}).collect()}
    assert five[201806] == (2 + 3 + 4 + 5 + 6) / 5


def test_missing_history_counts_as_zero_only_if_asked(spark):
    df = spark.createDataFrame([(1, 201801, None), (1, 201802, 4.0), (1, 201803, 1.0)], "k int, p int, x double")
    plain = {r.p: r.m for r in panel.history(df, "k", "p", "x", {"m": "avg"}).collect()}
    zeroed = {r.p: r.m for r in panel.history(df, "k", "p", "x", {"m": "avg"}, null_as_zero=True).collect()}
    assert plain == {201801: None, 201802: None, 201803: 4.0}
    assert zeroed == {201801: None, 201802: 0.0, 201803: 2.0}


def test_completing_a_panel(rows):
    needed = rows.where(F.col("p") >= 201711)
    assert {r.k for r in panel.incomplete_keys(needed, "k").collect()} == {2, 3, 4, 6}
    assert {r.k for r in panel.panel_semi_anti(needed, "k", "p", 201802).collect()} == {1, 2, 3, 5, 6}
    filled = panel.panel_gap_fill(rows, "k", "p", 201802).collect()
    assert sorted((r.k, r.p) for r in filled if r.k in (2, 3)) == [(k, p) for k in (2, 3) for p in backward_month_list(201802, 3)]
    assert all(r.x is None for r in filled if (r.k, r.p) in {(2, 201712), (3, 201711), (6, 201711)})
    assert len(filled) == len(ROWS) + 1 + 3 + 1


def test_set_difference_is_distinct(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(3,), (3,), (4,)], "k int")
    assert sorted(r.k for r in panel.set_difference(a, b, "k").collect()) == [1, 2]


def test_rescaling(spark):
    df = spark.createDataFrame([(0.0, 1.0), (5.0, 1.0), (10.0, 1.0)], "x double, c double")
    got = panel.rescale_features(df, ["x", "c"]).collect()
    assert [r.x for r in got] == [100.0, 0.0, -100.0] and all(r.c is None for r in got)
    assert [round(r.x, 6) for r in panel.standardise_features(df, ["x"]).collect()] == [-1.0, 0.0, 1.0]
