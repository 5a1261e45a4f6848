"""Sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.views import (
    DATES, EXPERIMENTS, HYPERPARAMS, LABELLED, MODEL_SCORES, MODELS, PANEL_C, PANEL_S, PLANS, SCORES,
    Query, dates, experiments, hyperparams, labelled, model_scores, panel_c, panel_s, plans, scores, with_,
)
from tidepanel.functions.periods import days_to_snapshot
from tidepanel.operators.ensemble import top_n_ids
from tidepanel.operators.ledger import Ledger
from tidepanel.session import scratch_path
from tidepanel.sources import readers, writers
from tidepanel.sources.schema import struct_of

PANEL_SCHEMA = "k bigint, p int, t int, m double"
MONTHS = [199706, 199705, 199704, 199703]


def _sparse(spark, sf):
    return panel_c(spark, sf).select("k", "p", "t", "m")


def _tsv_file(df, name, header=True, null_token=""):
    path = scratch_path(df.sparkSession, name)
    df.write.option("sep", "\t").option("header", str(header).lower()).option("nullValue", null_token).csv(path)
    return path


def _by_month(spark, sf):
    path = scratch_path(spark, "months")
    writers.write_by_period(_sparse(spark, sf), path, "p")
    return path


def _class_table(spark, sf):
    path = scratch_path(spark, "labelled")
    writers.write_parquet_by_period(labelled(spark, sf).select("k", "p", "v", "clase"), path, "p")
    return path


def scan_snapshots_(spark, sf):
    return readers.scan_snapshots(spark, _by_month(spark, sf), MONTHS, struct_of(PANEL_SCHEMA), "p")


def write_by_period_(spark, sf):
    """All months read back, each under its own folder name."""
    back = spark.read.schema(struct_of("k bigint, t int, m double, p int")).option("sep", "\t").option("header", "true").csv(_by_month(spark, sf))
    return back.select("k", "p", "t", "m")


def scan_master_(spark, sf):
    """The whole file, its dates made relative on the way."""
    path = _tsv_file(dates(spark, sf).select("id", "line", "p", "d"), "master")
    master = readers.scan_master(spark, path, struct_of("id bigint, line int, p int, d int"))
    return master.withColumn("d", days_to_snapshot(F.col("p"), F.col("d")))


def bulk_load_typed_(spark, sf):
    source = panel_s(spark, sf).select("k", "p", "n", "a", "b")
    path = _tsv_file(source, "delimited")
    loaded = readers.bulk_load_typed(spark, path, struct_of("k bigint, p int, n int, a double, b double"), scratch_path(spark, "loaded"), "p")
    return loaded.select(*source.columns)


def scan_predictions_(spark, sf):
    rows = model_scores(spark, sf)
    files = {}
    for m in MODELS:
        files[str(m)] = scratch_path(spark, f"model-{m}")
        one = rows.where(F.col("model") == m).select(F.col("id").alias("X"), "prob", "class")
        one.write.option("header", "true").csv(files[str(m)])
    return readers.scan_predictions(spark, files, struct_of("X bigint, prob double, class int"))


def scan_custom_na_(spark, sf):
    path = _tsv_file(panel_s(spark, sf).select("k", "p", "a", "b"), "custom-na", header=False, null_token="NAN")
    return readers.scan_custom_na(spark, path, struct_of("k bigint, p int, a double, b double"))


def write_id_list_(spark, sf):
    path = scratch_path(spark, "ids")
    writers.write_id_list(top_n_ids(scores(spark, sf)), path, "id")
    return spark.read.text(path).select(F.col("value").alias("id"))


def ledger_append_(spark, sf):
    """Experiments appended to a ledger, and what it holds of them and their hyperparameters."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    with_params = experiments(spark, sf).join(hyperparams(spark, sf), "id")
    ledger.append_frame(with_params, "params")
    kept = ledger.experiments().select("id", "plan_id", "profit", "train_periods", "auc_testing")
    return kept.join(ledger.hyperparams(), kept["id"] == F.col("experiment_id")).drop("experiment_id")


def ledger_finish_(spark, sf):
    """Plans once their finishing events are known: the last order of those with orders in the last months."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    rows = plans(spark, sf)
    ledger.add_plans(rows.withColumn("finished", F.lit(None).cast("timestamp")))
    ledger.finish_frame(rows.where(F.col("finished").isNotNull()))
    return ledger.plans().select("id", "train", "test", F.date_format("finished", "yyyy-MM-dd").alias("finished"))


QUERIES = {
    "scan_snapshots": Query(scan_snapshots_, with_(PANEL_C) + f"SELECT k, p, t, m FROM panel_c WHERE p IN ({', '.join(map(str, MONTHS))})"),
    "scan_master": Query(
        scan_master_,
        with_(DATES) + """
SELECT id, line, p, CAST(CAST(strptime(CAST(p AS VARCHAR) || '01', '%Y%m%d') + INTERVAL 1 MONTH AS DATE)
                         - CAST(try_strptime(CAST(d AS VARCHAR), '%Y%m%d') AS DATE) AS INTEGER) AS d FROM dates""",
    ),
    "bulk_load_typed": Query(bulk_load_typed_, with_(PANEL_S) + "SELECT k, p, n, a, b FROM panel_s"),
    "scan_period_table": Query(
        lambda spark, sf: readers.scan_period_table(spark, _class_table(spark, sf), MONTHS, "p").select("k", "p", "v"),
        with_(PANEL_S) + f"SELECT k, p, v FROM panel_s WHERE p IN ({', '.join(map(str, MONTHS))})",
    ),
    "scan_table_all": Query(
        lambda spark, sf: readers.scan_table_all(spark, _class_table(spark, sf)).select("k", "p", "v", "clase"),
        with_(LABELLED) + "SELECT k, p, v, clase FROM labelled",
    ),
    "scan_by_class": Query(
        lambda spark, sf: readers.scan_by_class(spark, _class_table(spark, sf), "BAJA+1", MONTHS, "clase", "p").select("k", "p", "v"),
        with_(LABELLED) + f"SELECT k, p, v FROM labelled WHERE clase = 'BAJA+1' AND p IN ({', '.join(map(str, MONTHS))})",
    ),
    "scan_predictions": Query(scan_predictions_, with_(MODEL_SCORES) + "SELECT id, CAST(model AS VARCHAR) AS model, prob, class FROM model_scores"),
    "scan_custom_na": Query(scan_custom_na_, with_(PANEL_S) + "SELECT k, p, a, b FROM panel_s"),
    "write_by_period": Query(write_by_period_, with_(PANEL_C) + "SELECT k, p, t, m FROM panel_c"),
    "write_id_list": Query(
        write_id_list_, with_(SCORES) + "SELECT CAST(id AS VARCHAR) AS id FROM (SELECT id FROM scores ORDER BY prob DESC, id LIMIT 7664)"
    ),
    "ledger_append": Query(
        ledger_append_,
        with_(EXPERIMENTS, HYPERPARAMS) + """
SELECT id, plan_id, profit, train_periods, NULL::DOUBLE AS auc_testing, name, value
FROM experiments JOIN hyperparams ON experiment_id = id""",
    ),
    "ledger_finish": Query(ledger_finish_, with_(PLANS) + "SELECT id, train, test, strftime(finished, '%Y-%m-%d') AS finished FROM plans"),
}
