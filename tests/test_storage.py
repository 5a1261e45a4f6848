import datetime as dt
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidepanel.operators import clean, ledger as L, profile, reconcile
from tidepanel.session import scratch_path, shared_dir
from tidepanel.sources import readers, writers
from tidepanel.sources.schema import EXPERIMENTS, snapshot_schema, struct_of

ROWS = [(1, 201801, 1.5, "CONTINUA"), (2, 201801, None, None), (1, 201802, -2.0, "BAJA+1"), (3, 201803, 0.0, "BAJA+2")]
SCHEMA = "k int, foto_mes int, x double, c string"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def same(a, b, period="foto_mes"):
    return all(r.only_left == r.only_right == 0 for r in reconcile.reconcile_anti(a, b, period).collect())


def test_months_written_and_read_back(spark, table):
    path = scratch_path(spark, "months")
    writers.write_by_period(table, path)
    back = readers.scan_snapshots(spark, path, [201801, 201802, 201803], struct_of(SCHEMA))
    assert same(table, back) and back.dtypes == table.dtypes
    some = readers.scan_snapshots(spark, path, [201802], struct_of(SCHEMA))
    assert [tuple(r) for r in some.collect()] == [ROWS[2]]
    # The month is a partition filter: other folders are not read.
    assert re.search(r"PartitionFilters: \[[^\]]*foto_mes", some._jdf.queryExecution().executedPlan().toString())


def test_single_files_by_name(spark, table, tmp_path):
    for p in (201801, 201802):
        table.where(F.col("foto_mes") == p).coalesce(1).write.option("sep", "\t").option("header", "true").csv(str(tmp_path / f"{p}_dias.txt"))
    got = readers.scan_snapshot_files(spark, str(tmp_path / "{period}_dias.txt"), [201801, 201802], struct_of(SCHEMA))
    assert got.count() == 3


def test_bulk_load_stops_at_wrong_types(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("k\tfoto_mes\tx\tc\n1\t201801\t\tA\n2\t201802\t2.5\t\n")
    bad.write_text("k\tfoto_mes\tx\tc\n1\t201801\tmany\tA\n")
    loaded = readers.bulk_load_typed(spark, str(good), struct_of(SCHEMA), str(tmp_path / "out"))
    assert sorted(map(tuple, loaded.select("k", "foto_mes", "x", "c").collect())) == [(1, 201801, None, "A"), (2, 201802, 2.5, None)]
    with pytest.raises(Exception, match="FAILFAST"):
        readers.read_typed(spark, str(bad), struct_of(SCHEMA)).collect()


def test_custom_missing_token(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\tNAN\tx\nNAN\t2.5\tNAN\n")
    got = readers.scan_custom_na(spark, str(tmp_path / "a.txt"), struct_of("a int, b double, c string")).collect()
    assert [tuple(r) for r in got] == [(1, None, "x"), (None, 2.5, None)]


def test_id_list_keeps_order_and_has_no_header(spark, tmp_path):
    df = spark.createDataFrame([(i, 1.0 / i) for i in (3, 1, 2)], "id int, prob double").orderBy(F.col("prob").desc())
    writers.write_id_list(df.limit(3), str(tmp_path / "ids"), "id")
    assert [r.value for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["1", "2", "3"]


def test_reconcile_counts_nulls_and_copies(spark):
    schema = "p int, a int, b string"
    left = spark.createDataFrame([(1, None, "x"), (1, 1, None), (1, 1, None), (2, 5, "y"), (2, 5, "y")], schema)
    right = spark.createDataFrame([(1, None, "x"), (1, 1, None), (2, 6, "y")], schema)
    got = {r.p: (r.only_left, r.only_right) for r in reconcile.reconcile_anti(left, right, "p").collect()}
    assert got == {1: (0, 0), 2: (2, 1)}
    only = reconcile.rows_only_in_left(left, right).collect()
    assert [(r.p, r.a, r.b, r.n_left) for r in only] == [(2, 5, "y", 2)]


def test_types_are_compared_and_aligned(spark):
    stored = spark.createDataFrame([(1, None)], "k int, c string")
    filed = spark.createDataFrame([("1", "")], "k string, c string")
    assert reconcile.compare_types(stored, filed) == [("k", "int", "string")]
    agreed = reconcile.reconcile_types(filed, stored, ["c"])
    assert agreed.collect() == stored.collect() and not reconcile.compare_types(agreed, stored)


def test_cleaning(spark):
    df = spark.createDataFrame([("", '"a"', 1.0), ("x", "b", None), ("", "c", float("nan")), ("", "d", None)], "s string, q string, v double")
    cleaned = clean.strip_quotes(clean.empty_to_null(df), "q")
    assert [r.s for r in cleaned.collect()] == [None, "x", None, None] and cleaned.first().q == "a"
    assert clean.sparse_columns(cleaned, 0.7) == ["s", "v"]
    a, b = clean.drop_sparse_columns(cleaned, df, threshold=0.7)
    assert a.columns == b.columns == ["q"]
    assert clean.select_trend_columns(df, ["s"]) == ["q", "v"]
    for wrong in (lambda: clean.select_trend_columns(df, ["antig_ratio"]), lambda: clean.drop_columns(df, ["nope"])):
        with pytest.raises(ValueError):
            wrong()
    assert clean.reorder_column(df, "s").columns == ["q", "v", "s"]
    assert {r.column_type: r.n_columns for r in profile.columns_by_type(df).collect()} == {"string": 2, "double": 1}
    counts = {r.column_type: r.n_columns for r in profile.columns_by_type(spark.createDataFrame([], snapshot_schema())).collect()}
    assert counts == {"int": 95, "double": 74, "string": 1}


def test_unseen_levels_get_a_code_of_their_own(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    coded = clean.categorical_encoder(train, ["c"]).transform(spark.createDataFrame([("a",), ("b",), ("z",)], "c string"))
    assert [r.c_code for r in coded.collect()] == [0.0, 1.0, 2.0]


def experiment(id, plan, profit, ratio=0.5, loss=0.25, minutes=30.0, test="201804"):
    return (id, plan, float(profit), ratio, loss, minutes, 0.02, "201802", test)


@pytest.fixture
def experiments(spark):
    rows = [
        experiment(1, 10, 5), experiment(2, 10, 9, ratio=0.75, minutes=60.0), experiment(3, 10, 9, ratio=0.75), experiment(4, 11, 2, loss=0.125),
        experiment(5, 11, 1, ratio=None), experiment(6, 12, 7, ratio=None, test="201806"),
    ]
    return spark.createDataFrame(
        rows, "id bigint, plan_id int, profit double, perfect_profit_ratio double, logloss_testing double, minutes_taken double,"
        " cutoff double, train_periods string, test_periods string"
    )


def test_best_rows_and_ties(experiments):
    assert {r.plan_id: (r.id, r.metric) for r in L.best_by_max(experiments).collect()} == {10: (2, 0.75), 11: (4, 0.5), 12: (6, None)}
    assert {r.plan_id: r.id for r in L.best_by_min(experiments).collect()} == {10: 1, 11: 4, 12: 6}
    assert [(r.plan_id, r.metric) for r in L.best_by_ratio(experiments).collect()] == [(11, 4.0), (10, 3.0), (12, None)]
    assert {r.plan_id: r.id for r in L.rows_at_group_max(experiments).collect()} == {10: 2, 11: 4, 12: 6}


def test_search_evolution(experiments):
    got = sorted((r.plan_id, r.id, r.hours, r.best_profit) for r in L.search_evolution(experiments).collect())
    assert got[:3] == [(10, 1, 0.5, 5.0), (10, 2, 1.5, 9.0), (10, 3, 2.0, 9.0)]


def test_ledger_life(spark, experiments):
    ledger = L.Ledger(spark, scratch_path(spark, "ledger"))
    assert ledger.next_plan() is None and ledger.experiments().count() == 0
    ledger.add_plans(spark.createDataFrame([(2, "201802, 201801", "201804"), (1, "201802", "201804")], "id int, train string, test string").withColumn("finished", F.lit(None)))
    assert ledger.next_plan()["id"] == 1
    first = ledger.append({"experiment_code": "a", "profit": 1.5, "plan_id": 1}, {"depth": 6, "task_type": "GPU", "learning_rate": 0.5})
    second = ledger.append({"experiment_code": "b", "profit": 2.5, "plan_id": 1})
    assert (first, second) == (1, 2) and ledger.experiments().schema == EXPERIMENTS
    assert all(isinstance(r.finished, dt.datetime) for r in ledger.experiments().collect())
    held = {(r.experiment_id, r.name): r.value for r in ledger.hyperparams().collect()}
    assert held == {(1, "depth"): "6", (1, "learning_rate"): "0.5"}
    ledger.finish(1)
    assert ledger.next_plan()["id"] == 2
    ledger.finish(2)
    assert ledger.next_plan() is None and ledger.plans().count() == 2
    ledger.append_frame(experiments)
    assert ledger.experiments().count() == 8
    best = L.best_by_max(ledger.experiments(), "profit")
    assert L.hyperparams_of_best(ledger.hyperparams(), best).count() == 0


def test_catalog_table_or_folder(spark, table):
    table.createOrReplaceTempView("months_view")
    assert readers.scan_table_all(spark, "months_view").count() == 4
    assert [r.k for r in readers.scan_by_class(spark, "months_view", "BAJA+1", [201801, 201802], label="c").collect()] == [1]
    with pytest.raises(AnalysisException):
        readers.scan_table_all(spark, "no_such_table").count()


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
