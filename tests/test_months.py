"""A store extended month by month holds what one build over all months makes."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.panel import PanelSpec, panel_features
from tidepanel.plans.months import MonthStore
from tidepanel.session import scratch_path

SPEC = PanelSpec(key="k", period="p", features=("v", "w"), max_min=True)
MONTHS = [201710, 201711, 201712, 201801, 201802, 201803]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = [(k, p, rng.choice((None, float(rng.randint(-5, 5)))), float(rng.randint(0, 9))) for k in range(60) for p in MONTHS if rng.random() < 0.7]
    return spark.createDataFrame(data, "k int, p int, v double, w double").cache()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


@pytest.fixture()
def store(spark, rows):
    return MonthStore(spark, scratch_path(spark, "months"), SPEC, rows.schema)


def test_month_by_month_equals_one_build(rows, store):
    for p in MONTHS:
        store.append(rows, [p])
    assert same(store.features(), panel_features(rows, SPEC)) and same(store.rows(), rows)
    # A run that is repeated, or a batch over months that are there, changes nothing.
    store.append(rows, [201803])
    store.append(rows, [201801, 201802])
    assert same(store.features(), panel_features(rows, SPEC))
    assert same(store.features([201712]), panel_features(rows, SPEC, [201712]))


def test_only_three_months_are_read(rows, store):
    store.append(rows, MONTHS[:-1])
    for path in glob.glob(f"{store.path}/rows/p=20171[01]/*.parquet"):
        with open(path, "wb") as broken:
            broken.write(b"no parquet")
    store.append(rows, [201803])
    assert same(store.features([201803]), panel_features(rows, SPEC, [201803]))


def test_a_month_delivered_again(rows, store):
    store.append(rows, MONTHS)
    other = rows.where("p = 201711 AND k < 40").withColumn("v", F.coalesce("v", F.lit(0.0)) + 1)
    store.restate(other, 201711)
    now = rows.where("p <> 201711").unionByName(other)
    assert same(store.rows(), now) and same(store.features(), panel_features(now, SPEC))
