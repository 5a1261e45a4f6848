"""Reconciling by hashes finds what reconciling by rows finds, and moves no rows of equal tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidepanel.catalog import relations
from tidepanel.operators import reconcile

SCHEMA = "p int, k bigint, a string, b double, c string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(201801 + i % 5, i, rng.choice(("x", "y", None)), rng.choice((None, 0.0, 1.5, float("nan"))), rng.choice(("x", None))) for i in range(1500)]
    # Copies, and rows that only differ by which column is null.
    return made + made[:40] + [(201801, -1, "x", None, None), (201801, -1, None, None, "x"), (None, 7, None, None, None)]


def by_month(df):
    return {r["p"]: (r["only_left"], r["only_right"]) for r in df.collect()}


def test_equal_tables_in_another_order(spark, rows):
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    assert reconcile.differing_buckets(left, right, "p").count() == 0
    assert by_month(reconcile.reconcile_by_hash(left, right, "p")) == dict.fromkeys((None, *range(201801, 201806)), (0, 0))


@pytest.mark.parametrize("change", [
    lambda r: r[:3] + [(201803, 2, "x", 9.0, None)] + r[4:], lambda r: r[:-3] + r[-2:], lambda r: r + [(209901, 1, "new", 1.0, "month")],
    lambda r: [(*x[:4], x[2]) if i == 700 else x for i, x in enumerate(r)], lambda r: [x for x in r if x[0] != 201802], lambda r: [],
    lambda r: [(x[0], x[1], None, None, "x") if x[1] == -1 else x for x in r],
])
def test_planted_differences(spark, rows, change):
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(change(list(rows)), SCHEMA)
    for a, b in ((left, right), (right, left)):
        assert by_month(reconcile.reconcile_by_hash(a, b, "p", buckets=64)) == by_month(reconcile.reconcile_anti(a, b, "p"))


def test_every_single_change_is_seen(spark, rows):
    """A change of one value in one row, for every column and a hundred rows."""
    left = spark.createDataFrame(rows, SCHEMA)
    for at, other in ((0, 201705), (1, -99), (2, "zz"), (3, 77.5), (4, "zz")):
        changed = [tuple(other if i % 15 == 0 and k == at else v for k, v in enumerate(r)) for i, r in enumerate(rows)]
        right = spark.createDataFrame(changed, SCHEMA)
        assert by_month(reconcile.reconcile_by_hash(left, right, "p")) == by_month(reconcile.reconcile_anti(left, right, "p"))


def test_another_number_of_copies_is_a_differing_bucket(spark, rows):
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows + rows[:1], SCHEMA)
    assert reconcile.differing_buckets(left, right, "p").collect()[0]["period"] == 201801


def test_rows_of_equal_buckets_stay_where_they_are(spark, rows):
    """What is shuffled before the rows are asked for is a row per month and bucket and task."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = reconcile.signatures(df, df.columns, "p", 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    assert reconcile.signatures(df, df.columns, "p", 8).count() <= 6 * 8
    assert df.select(reconcile.row_hash(["a", "c"])).where(F.col("a").isNull() | F.col("c").isNull()).distinct().count() > 2


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_of_tables_spread_alike_do_not_pile_up_in_one_task(spark):
    """Both tables come out of a shuffle by one of their columns; their rows are shuffled once more before they are counted."""
    made = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("id") > 500, 1)).alias("b"))
    other = made.where("k < 60").unionByName(made.where("k >= 90").withColumn("n", F.lit(-1).cast("bigint")))
    balance = reconcile.row_balance(made, other)
    above, union, _ = physical(balance).partition("Union")
    assert union and "Exchange" in above
    assert balance.columns == ["k", "n", "b", "n_left", "n_right"]
    got = {(r.k, r.n): (r.n_left, r.n_right) for r in balance.collect()}
    assert got == {(k, 10): (1, int(k < 60)) for k in range(100)} | {(k, -1): (0, 1) for k in range(90, 100)}


ORDERS = [
    (1, "1995-01-01", 350_000.0), (1, "1995-01-20", 400_000.0), (1, "1995-02-01", 400_000.0), (2, "1995-01-01", 400_000.01), (2, "1995-02-01", 600_000.0),
    (2, "1995-03-01", 600_000.01), (3, "1995-01-01", 700_000.0), (3, "1995-02-01", 700_000.01), (4, "1995-01-01", None), (None, "1995-01-01", 1.0),
    (None, "1995-01-01", 2.0), (5, None, 5.0), (5, None, 800_000.0),
]


@pytest.fixture()
def orders(spark, tmp_path):
    made = spark.createDataFrame(ORDERS, "o_custkey bigint, d string, o_totalprice double")
    made.select("o_custkey", F.col("d").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_the_second_version_is_made_in_one_pass(spark, orders):
    left, right = relations._two_versions(spark, orders)
    once, again = left.where("m <= 40000000").unionByName(left.where("m > 60000000")), left.where("m > 70000000").withColumn("t", F.lit(99))
    told = lambda df: sorted(map(repr, df.collect()))
    assert right.columns == left.columns == ["k", "p", "t", "m"] and len(told(right)) == 10
    assert told(right) == told(once.unionByName(again))
    assert "Union" not in physical(right)


def test_the_panel_of_both_versions_is_made_once(spark, orders):
    """The tasks that count rows read a written panel and hold no groups of the panel besides their own."""
    left, right = relations._two_versions(spark, orders)
    plan = physical(reconcile.row_balance(left, right))
    assert "FileScan" not in plan and plan.count("HashAggregate") == 2
    assert left.count() == 10
