"""The test tables in the shapes the operators work on, as DataFrames and as SQL.

Money is kept in whole cents and quantities are whole numbers, so that sums are
exact in doubles and do not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.derived import present_formulas
from tidepanel.functions.periods import month_index, period_of_date
from tidepanel.operators.panel import monthly

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def panel_s(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier by month of shipping: dense."""
    lines = table(spark, sf, "lineitem").withColumns({"k": F.col("l_suppkey"), "p": period_of_date(F.col("l_shipdate"))})
    made = monthly(
        lines, "k", "p",
        {
            "n": F.count(F.lit(1)).cast("int"),
            "v": F.sum("l_quantity"),
            "m": F.sum(cents("l_extendedprice")).cast("double"),
            "a": F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))),
            "b": F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))),
            "r": F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))),
        },
    )
    return made.withColumn("mi", month_index(F.col("p")))


PANEL_S = """panel_s AS (
  SELECT k, p, n, v, m, a, b, r, CAST((p // 100) * 12 + p % 100 AS INTEGER) AS mi FROM (
    SELECT l_suppkey AS k, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS p,
           CAST(count(*) AS INTEGER) AS n, sum(l_quantity) AS v,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS m,
           sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS a,
           sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS b,
           sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r
    FROM lineitem GROUP BY 1, 2))"""


def panel_c(spark: SparkSession, sf: str) -> DataFrame:
    """Customer by month of ordering: sparse."""
    orders = table(spark, sf, "orders").withColumns({"k": F.col("o_custkey"), "p": period_of_date(F.col("o_orderdate"))})
    made = monthly(orders, "k", "p", {"t": F.count(F.lit(1)).cast("int"), "m": F.sum(cents("o_totalprice")).cast("double")})
    return made.withColumn("mi", month_index(F.col("p")))


PANEL_C = """panel_c AS (
  SELECT k, p, t, m, CAST((p // 100) * 12 + p % 100 AS INTEGER) AS mi FROM (
    SELECT o_custkey AS k, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS p,
           CAST(count(*) AS INTEGER) AS t,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS m
    FROM orders GROUP BY 1, 2))"""

MODELS = (464, 529, 384, 137, 261, 0)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """One score per order, with ties and a class."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        ((F.col("o_orderkey") * 7919) % 10007 / F.lit(10007.0)).alias("prob"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("class"),
        period_of_date(F.col("o_orderdate")).alias("p"),
    )


SCORES = """scores AS (
  SELECT o_orderkey AS id, (o_orderkey * 7919) % 10007 / 10007.0::DOUBLE AS prob,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS class,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS p
  FROM orders)"""


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of six models in long form; each later model starts a month later, so ids are missing."""
    models = F.posexplode(F.array(*[F.lit(m) for m in MODELS])).alias("pos", "model")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", models)
    prob = (F.col("o_orderkey") * (F.lit(7919) + F.col("pos") * 2)) % 10007 / F.lit(10007.0)
    return rows.where(period_of_date(F.col("o_orderdate")) > F.lit(199500) + F.col("pos")).select(
        F.col("o_orderkey").alias("id"), "model", prob.alias("prob"),
        F.when((F.col("o_orderstatus") == "F") | ((F.col("o_orderstatus") == "P") & (F.col("model") == 137)), F.lit(1)).otherwise(F.lit(0)).alias("class"),
    )


MODEL_SCORES = """model_scores AS (
  SELECT o_orderkey AS id, model, (o_orderkey * (7919 + pos * 2)) % 10007 / 10007.0::DOUBLE AS prob,
         CAST(CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND model = 137) THEN 1 ELSE 0 END AS INTEGER) AS class
  FROM orders, (VALUES (0, 464), (1, 529), (2, 384), (3, 137), (4, 261), (5, 0)) AS models(pos, model)
  WHERE year(o_orderdate) * 100 + month(o_orderdate) > 199500 + pos)"""


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of experiments: one per order, one plan per customer."""
    key, period = F.col("o_orderkey"), period_of_date(F.col("o_orderdate"))
    before = F.date_format(F.add_months(F.col("o_orderdate"), -2), "yyyyMM")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        F.col("o_custkey").cast("int").alias("plan_id"),
        F.col("o_orderpriority").alias("experiment_code"),
        (key % 97 + 1).cast("double").alias("minutes_taken"),
        cents("o_totalprice").cast("double").alias("profit"),
        ((key * 13 + F.col("o_custkey") * 37) % 1000 / F.lit(1000.0) + F.lit(0.125)).alias("logloss_testing"),
        ((key * 17 + F.col("o_custkey")) % 101 / F.lit(128.0)).alias("perfect_profit_ratio"),
        ((key * 31) % 101 / F.lit(1024.0)).alias("cutoff"),
        before.alias("train_periods"),
        period.cast("string").alias("test_periods"),
    )


EXPERIMENTS = """experiments AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS INTEGER) AS plan_id, o_orderpriority AS experiment_code,
         CAST(o_orderkey % 97 + 1 AS DOUBLE) AS minutes_taken,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS profit,
         (o_orderkey * 13 + o_custkey * 37) % 1000 / 1000.0::DOUBLE + 0.125::DOUBLE AS logloss_testing,
         (o_orderkey * 17 + o_custkey) % 101 / 128.0::DOUBLE AS perfect_profit_ratio,
         (o_orderkey * 31) % 101 / 1024.0::DOUBLE AS cutoff,
         strftime(o_orderdate - INTERVAL 2 MONTH, '%Y%m') AS train_periods,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR) AS test_periods
  FROM orders)"""


def hyperparams(spark: SparkSession, sf: str) -> DataFrame:
    """Hyperparameters of each experiment as a map, among them settings that are none."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.create_map(
            F.lit("depth"), (F.col("o_orderkey") % 10 + 1).cast("string"),
            F.lit("iterations"), (F.col("o_orderkey") % 1000 + 250).cast("string"),
            F.lit("task_type"), F.lit("GPU"),
            F.lit("loss_function"), F.lit("Logloss"),
        ).alias("params"),
    )


HYPERPARAMS = """hyperparams AS (
  SELECT o_orderkey AS experiment_id, 'depth' AS name, CAST(o_orderkey % 10 + 1 AS VARCHAR) AS value FROM orders
  UNION ALL
  SELECT o_orderkey, 'iterations', CAST(o_orderkey % 1000 + 250 AS VARCHAR) FROM orders)"""


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """Plans: one per customer; pending until the customer has an order in the last months."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").cast("int").alias("id"))
        .agg(
            F.min(period_of_date(F.col("o_orderdate"))).cast("string").alias("train"),
            F.max(period_of_date(F.col("o_orderdate"))).cast("string").alias("test"),
            F.max(F.when(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz"), F.col("o_orderdate"))).cast("timestamp").alias("finished"),
        )
    )


PLANS = """plans AS (
  SELECT CAST(o_custkey AS INTEGER) AS id,
         CAST(min(year(o_orderdate) * 100 + month(o_orderdate)) AS VARCHAR) AS train,
         CAST(max(year(o_orderdate) * 100 + month(o_orderdate)) AS VARCHAR) AS test,
         max(CASE WHEN o_orderdate >= TIMESTAMP '2001-06-01' THEN o_orderdate END) AS finished
  FROM orders GROUP BY 1)"""


def dates(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot month and an integer date whose day part (a quantity) is often impossible."""
    o = table(spark, sf, "orders").select("o_orderkey", period_of_date(F.col("o_orderdate")).alias("p"))
    day = period_of_date(F.col("l_shipdate")) * 100 + F.col("l_quantity").cast("int")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", day.alias("d"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "p", "d"
    )


DATES = """dates AS (
  SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part,
         CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS p,
         CAST((year(l_shipdate) * 100 + month(l_shipdate)) * 100 + CAST(l_quantity AS INTEGER) AS INTEGER) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier months with a ternary class from the months after: who falls below half of today's quantity."""
    from pyspark.sql import Window as W

    ahead = W.partitionBy("k").orderBy("mi")
    later = {i: F.max("v").over(ahead.rangeBetween(i, i)) for i in (1, 2)}
    half = F.col("v") / 2
    label = (
        F.when(F.coalesce(later[1], F.lit(0.0)) < half, F.lit("BAJA+1"))
        .when(F.coalesce(later[2], F.lit(0.0)) < half, F.lit("BAJA+2"))
        .otherwise(F.lit("CONTINUA"))
    )
    return panel_s(spark, sf).withColumn("clase", label)


LABELLED = PANEL_S + """,
labelled AS (
  SELECT t.*, CASE WHEN coalesce(f1.v, 0) < t.v / 2 THEN 'BAJA+1'
                   WHEN coalesce(f2.v, 0) < t.v / 2 THEN 'BAJA+2' ELSE 'CONTINUA' END AS clase
  FROM panel_s t
  LEFT JOIN panel_s f1 ON f1.k = t.k AND f1.mi = t.mi + 1
  LEFT JOIN panel_s f2 ON f2.k = t.k AND f2.mi = t.mi + 2)"""


def bank_inputs() -> list[str]:
    """Snapshot columns that the derived features read."""
    made = {f.name for f in present_formulas()}
    return list(dict.fromkeys(c for f in present_formulas() for c in f.inputs + f.over if c not in made))


# Panel measures dealt out in turn over the bank columns: with nulls, zeros and negative values among them.
_BANK_MEASURES = ("a", "b", "CAST(n - 7 AS DOUBLE)", "v", "a - b", "CAST(n % 3 AS DOUBLE)", "r")


def _bank_columns() -> list[str]:
    return [f"{_BANK_MEASURES[i % len(_BANK_MEASURES)]} AS {c}" for i, c in enumerate(bank_inputs())]


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """The panel under the column names of the bank snapshot."""
    return panel_s(spark, sf).selectExpr("k", "p", *_bank_columns())


BANK = PANEL_S + ",\nbank AS (SELECT k, p, " + ", ".join(_bank_columns()) + " FROM panel_s)"


def with_(*ctes: str) -> str:
    """``WITH`` clause of some of the views above, each once."""
    return "WITH " + ",\n".join(dict.fromkeys(ctes)) + "\n"
