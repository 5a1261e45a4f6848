"""Target statistics against a loop over the rows in their order."""

import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import encode
from tidepanel.operators.boost import BoostParams
from tidepanel.plans import boosting
from tidepanel.plans.training import Task


def plain(rows, prior, weight, seed):
    """(id, level, label) -> value of each row."""
    seen, out = {}, {}
    for i, level, label in sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}-{seed}".encode()).hexdigest(), r[0])):
        hits, n = seen.get(level, (0, 0))
        out[i] = (hits + prior * weight) / (n + weight)
        if label is not None:
            seen[level] = (hits + label, n + 1)
    return out, seen


@pytest.fixture(scope="module")
def rows():
    # One level holds most rows, one has a single row, some rows have no level or no label.
    return [(i, "once" if i == 8 else "hot" if i % 10 < 7 else None if i % 10 == 7 else f"l{i % 10}", None if i % 23 == 5 else int(i * i % 7 < 3)) for i in range(900)]


@pytest.mark.parametrize("prior, weight, seed", [(0.5, 1.0, 1), (0.1, 5.0, 3)])
def test_ordered(spark, rows, prior, weight, seed):
    df = spark.createDataFrame(rows, "id int, level string, y int").repartition(4)
    want, seen = plain(rows, prior, weight, seed)
    got = {r["id"]: r["level__ts"] for r in encode.ordered_target_statistics(df, "level", "y", "id", prior=prior, weight=weight, seed=seed).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    new = spark.createDataFrame([(1, "hot"), (2, None), (3, "never"), (4, "once")], "id int, level string")
    later = {r["id"]: r["v"] for r in encode.with_target_statistics(new, encode.target_totals(df, "level", "y"), "level", "v", prior, weight).collect()}
    value = lambda level: (seen[level][0] + prior * weight) / (seen[level][1] + weight)
    assert later == pytest.approx({1: value("hot"), 2: value(None), 3: prior, 4: value("once")})


def test_empty(spark):
    none = spark.createDataFrame([], "id int, level string, y int")
    assert encode.ordered_target_statistics(none, "level", "y", "id").count() == 0 and encode.target_totals(none, "level", "y").count() == 0
    assert [r["level__ts"] for r in encode.with_target_statistics(spark.createDataFrame([(1, "a")], "id int, level string"), encode.target_totals(none, "level", "y"), "level").collect()] == [0.5]


def test_a_hot_level_is_spread(spark, rows):
    """The running counts of the level with most rows are made in several blocks."""
    df = spark.createDataFrame([(i, "hot", i % 2) for i in range(4000)], "id int, level string, y int").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = encode.ordered_target_statistics(df, "level", "y", "id")
        parts = found.groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 3 and max(r["count"] for r in parts) < 2400


def test_levels_without_meaning_do_not_leak(spark):
    """A column with a level per row cannot tell the label; its mean label would tell it wholly."""
    data = [(i, f"only{i}", "ab"[i % 2 if i % 5 else 0], int(hashlib.md5(str(i).encode()).hexdigest()[0] in "01234567")) for i in range(800)]
    df = spark.createDataFrame(data, "id int, own string, pair string, y int").withColumn("y", F.when(F.col("pair") == "b", F.lit(1)).otherwise(F.col("y")))
    task = Task(df.where("id < 500"), df.where("id >= 500"), ("own", "pair"), ("id",), "y", ("own", "pair"))
    made = boosting.encode_task(task)
    assert made.features == ("own__ts", "pair__ts") and made.train.count() == 500 and made.categorical == ()
    assert {r["own__ts"] for r in made.train.collect()} == {0.5}
    found = boosting.train_eval(made, replace(BoostParams(), iterations=5, depth=2, border_count=15))
    assert found["auc_testing"] > 0.65 and abs(found["auc_training"] - found["auc_testing"]) < 0.15
