"""Spans with bounds of their own against a loop over all events."""

import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.between import history_between

MEASURES = {"n": "count", "total": "sum", "mean": "avg", "most": "max", "least": "min", "sd": "stddev_pop"}


def plain(rows, events):
    out = {}
    for i, key, low, high in rows:
        inside = [v for k, t, v in events if None not in (k, t, key, low, high) and k == key and low < t < high and v is not None]
        n = len(inside)
        mean = sum(inside) / n if n else None
        sd = (sum((v - mean) ** 2 for v in inside) / n) ** 0.5 if n else None
        out[i] = (n, sum(inside) if n else None, mean, max(inside, default=None), min(inside, default=None), sd)
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    events = [(rng.choice(["hot"] * 8 + ["b", "c", None]), rng.randint(-500, 900) if rng.random() < 0.97 else None, rng.choice((None, *range(-9, 10)))) for _ in range(1500)]
    events += [("hot", 40, 5)] * 20
    rows = [(i, rng.choice(["hot", "hot", "b", "none", None]), low := rng.randint(-600, 900), low + rng.choice((-5, 0, 1, 2, 3, 17, 64, 500, 3000))) for i in range(400)]
    rows += [(1000, "hot", None, 5), (1001, "hot", 5, None), (1002, "hot", 39, 41), (1003, "hot", 40, 41), (1004, "hot", -(10**6), 10**6)]
    return rows, events


@pytest.mark.parametrize("width, levels", [(1, 16), (1, 1), (1, 3), (7, 5), (64, 16), (64, 1), (5000, 2)])
def test_equals_a_loop(spark, made, width, levels):
    rows, events = made
    r, e = spark.createDataFrame(rows, "i int, k string, low bigint, high bigint"), spark.createDataFrame(events, "k string, t bigint, v bigint")
    found = history_between(r, e, ["i"], "k", F.col("low"), F.col("high"), F.col("t"), F.col("v"), MEASURES, width, levels).collect()
    want = plain(rows, events)
    assert len(found) == len(rows)
    for x in found:
        got, expected = tuple(x)[1:], want[x["i"]]
        assert got[:2] == expected[:2] and got[3:5] == expected[3:5] and got[2] == (pytest.approx(expected[2]) if expected[2] is not None else None)
        assert got[5] == (pytest.approx(expected[5], abs=1e-6) if expected[5] is not None else None)


def test_a_span_takes_few_nodes(spark):
    from tidepanel.operators.between import _nodes

    df = spark.range(0, 3000, 7).select(F.col("id").alias("a"), (F.col("id") * 3 + 50).alias("b"))
    for r in df.select("a", "b", _nodes(F.col("a"), F.col("b"), 16).alias("nodes")).collect():
        covered = sorted(x for n in r["nodes"] for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert covered == list(range(r["a"], r["b"])) and len(r["nodes"]) <= 2 * (r["b"] - r["a"]).bit_length()


def test_empty_tables_and_wrong_settings(spark, made):
    rows, events = made
    r, e = spark.createDataFrame(rows[:5], "i int, k string, low bigint, high bigint"), spark.createDataFrame(events, "k string, t bigint, v bigint")
    ask = lambda a, b, measures=MEASURES, width=7: history_between(a, b, ["i"], "k", F.col("low"), F.col("high"), F.col("t"), F.col("v"), measures, width)
    assert {tuple(x)[1:] for x in ask(r, e.where("t > 99999")).collect()} == {(0, None, None, None, None, None)}
    assert ask(r.where("i < 0"), e).count() == 0
    with pytest.raises(ValueError, match="median"):
        ask(r, e, {"m": "median"})
    with pytest.raises(ValueError, match="width"):
        ask(r, e, width=0)
