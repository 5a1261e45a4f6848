"""Scalar functions and column preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.views import (
    BANK, DATES, LABELLED, MODEL_SCORES, MODELS, PANEL_C, PANEL_S, SCORES,
    Query, bank, dates, labelled, model_scores, panel_c, panel_s, scores, table, with_,
)
from tidepanel.functions import columns as C
from tidepanel.functions import periods as P
from tidepanel.functions.derived import add_present_features, card_formulas, present_formulas
from tidepanel.operators import clean, panel
from tidepanel.operators.ensemble import ensemble_full_join

# --- periods and dates --------------------------------------------------------


def days_to_snapshot_(spark, sf):
    """Two dates per row: one as it is, one missing for half of the rows."""
    d = dates(spark, sf)
    second = F.when(F.col("part") > F.col("id"), F.col("d"))
    return d.select(
        "id", "line", "part", "p", "d",
        P.days_to_snapshot(F.col("p"), F.col("d")).alias("days"), P.days_to_snapshot(F.col("p"), second).alias("days2"),
    )


_NEXT_MONTH = "CAST(strptime(CAST(p AS VARCHAR) || '01', '%Y%m%d') + INTERVAL 1 MONTH AS DATE)"
_DATE = "CAST(try_strptime(CAST(d AS VARCHAR), '%Y%m%d') AS DATE)"
DAYS_SQL = with_(DATES) + f"""
SELECT id, line, part, p, d, CAST({_NEXT_MONTH} - {_DATE} AS INTEGER) AS days,
       CAST(CASE WHEN part > id THEN {_NEXT_MONTH} - {_DATE} END AS INTEGER) AS days2
FROM dates"""


def relative_period_(spark, sf):
    p = F.col("p")
    return panel_c(spark, sf).select(
        "k", "p",
        P.shift_period(p, -6).alias("before6"), P.shift_period(p, 2).alias("after2"), P.shift_period_text(p, -3).alias("text3"),
    )


RELATIVE_PERIOD_SQL = with_(PANEL_C) + """,
f AS (SELECT k, p, strptime(CAST(p AS VARCHAR) || '01', '%Y%m%d') AS d FROM panel_c)
SELECT k, p, CAST(strftime(d - INTERVAL 6 MONTH, '%Y%m') AS INTEGER) AS before6,
       CAST(strftime(d + INTERVAL 2 MONTH, '%Y%m') AS INTEGER) AS after2, strftime(d - INTERVAL 3 MONTH, '%Y%m') AS text3
FROM f"""


def _period_lists(spark, sf):
    """Months of each customer as a comma list: at most as many as there are months."""
    return panel_c(spark, sf).groupBy("k").agg(P.join_periods(F.sort_array(F.collect_list("p"))).alias("periods"))


def split_periods_(spark, sf):
    return _period_lists(spark, sf).select("k", F.posexplode(P.split_periods(F.col("periods"))).alias("pos", "p"))


def elapsed_(spark, sf):
    """Time between the first and last event of a user."""
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return spans.select(
        "user_id", F.round(P.elapsed(F.col("first"), F.col("last")), 2).alias("minutes"),
        P.elapsed(F.col("first"), F.col("last"), "seconds").alias("seconds"),
    )


ELAPSED_SQL = """
SELECT user_id, round(us / 60000000.0::DOUBLE, 2) AS minutes, us / 1000000.0::DOUBLE AS seconds
FROM (SELECT user_id, date_diff('microsecond', min(ts), max(ts)) AS us FROM events GROUP BY 1)"""

# --- arithmetic ---------------------------------------------------------------


def _on_panel(made):
    """A query over the dense panel; ``made`` gives its columns from those of the panel."""

    def run(spark, sf):
        columns = made(F.col("a"), F.col("b"), F.col("n"))
        return panel_s(spark, sf).select("k", "p", *[c.alias(name) for name, c in columns.items()])

    return run


def _panel_sql(expressions: str) -> str:
    return with_(PANEL_S) + f"SELECT k, p, {expressions} FROM panel_s"


def row_mean_(spark, sf):
    wide = ensemble_full_join(model_scores(spark, sf), MODELS)
    return wide.select("id", C.row_mean(*[F.col(f"prob_model_{m}") for m in MODELS]).alias("prob_mean"))


ROW_MEAN_SQL = with_(MODEL_SCORES) + """
SELECT id, CASE WHEN count(*) = 6 THEN (
    max(prob) FILTER (model = 464) + max(prob) FILTER (model = 529) + max(prob) FILTER (model = 384)
    + max(prob) FILTER (model = 137) + max(prob) FILTER (model = 261) + max(prob) FILTER (model = 0)) / 6 END AS prob_mean
FROM model_scores GROUP BY id"""

# Formulas of the derived bank columns as SQL.


def _formula_sql(f) -> str:
    def skip_sum(terms):
        return "(" + " + ".join(f"coalesce({c}, 0)" for c in terms) + ")"

    def plain_sum(terms):
        return "(" + " + ".join(terms) + ")"

    if f.op in ("max", "min"):
        return f"{'greatest' if f.op == 'max' else 'least'}({', '.join(f.inputs)})"
    if f.op == "skip_sum":
        return skip_sum(f.inputs)
    if f.op == "guarded":
        return f"CASE WHEN {f.over[0]} IS NULL OR {f.over[0]} = 0 THEN 0 ELSE {f.inputs[0]} / {f.over[0]} END"
    if f.op == "skip_ratio":
        return f"{skip_sum(f.inputs)} / nullif({skip_sum(f.over)}, 0)"
    return f"{plain_sum(f.inputs)} / nullif({plain_sum(f.over)}, 0)"


def present_features_(spark, sf):
    return add_present_features(bank(spark, sf)).select("k", "p", *[f.name for f in present_formulas()])


def present_ctes(source: str = "SELECT * FROM bank") -> str:
    """Views up to ``present``: the bank rows with all derived columns."""
    cards, rest = card_formulas(), [f for f in present_formulas() if not f.name.startswith("mv_")]
    first = ", ".join(f"{_formula_sql(f)} AS {f.name}" for f in cards)
    second = ", ".join(f"{_formula_sql(f)} AS {f.name}" for f in rest)
    return with_(BANK) + f", source AS ({source}),\ncards AS (SELECT *, {first} FROM source),\npresent AS (SELECT *, {second} FROM cards)"


# --- cleaning -----------------------------------------------------------------


def drop_columns_(spark, sf):
    return clean.drop_columns(table(spark, sf, "orders"), ["o_orderpriority", "o_orderdate", "o_totalprice"])


def fill_zero_(spark, sf):
    """Nulls, and NaN made from a division of zero by zero."""
    ratio = C.safe_div(F.col("n") - F.col("n"), F.coalesce("a", F.lit(0.0)), ieee=True)
    return panel_s(spark, sf).select("k", "p", C.fill_zero(F.col("a")).alias("a"), C.fill_zero(ratio).alias("from_nan"))


def empty_to_null_(spark, sf):
    """Text with empty values: the priority's words after the number, if it has no blank in it."""
    words = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.instr("o_orderpriority", " ") > 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.regexp_replace("o_orderstatus", "P", "").alias("status"),
    )
    return clean.empty_to_null(words)


def strip_quotes_(spark, sf):
    quoted = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit('"'), "o_orderpriority", F.lit('"')).alias("label"))
    return clean.strip_quotes(quoted, "label")


def _holed(spark, sf):
    """Supplier months of thin data: columns missing where the month saw none of the kind."""
    lines = table(spark, sf, "lineitem")
    big = F.col("l_quantity")
    return lines.groupBy("l_partkey").agg(
        F.sum(F.when(big > 45, big)).alias("over45"), F.sum(F.when(big > 10, big)).alias("over10"),
        F.sum(F.when(big > 49, big)).alias("over49"), F.sum(big).alias("total"),
    )


HOLED = """holed AS (
  SELECT l_partkey, sum(CASE WHEN l_quantity > 45 THEN l_quantity END) AS over45,
         sum(CASE WHEN l_quantity > 10 THEN l_quantity END) AS over10,
         sum(CASE WHEN l_quantity > 49 THEN l_quantity END) AS over49, sum(l_quantity) AS total
  FROM lineitem GROUP BY 1)"""


def drop_sparse_columns_(spark, sf):
    """The kept columns and their missing shares."""
    kept = clean.drop_sparse_columns(_holed(spark, sf))[0]
    shares = clean.missing_shares(kept)
    return shares.unpivot([], shares.columns, "column_name", "share").withColumn("share", F.round("share", 6))


DROP_SPARSE_SQL = with_(HOLED) + """,
s AS (SELECT 'over45' AS column_name, avg(CASE WHEN over45 IS NULL THEN 1.0 ELSE 0 END) AS share FROM holed
      UNION ALL SELECT 'over10', avg(CASE WHEN over10 IS NULL THEN 1.0 ELSE 0 END) FROM holed
      UNION ALL SELECT 'over49', avg(CASE WHEN over49 IS NULL THEN 1.0 ELSE 0 END) FROM holed
      UNION ALL SELECT 'l_partkey', 0.0 FROM holed GROUP BY 1 UNION ALL SELECT 'total', 0.0 FROM holed GROUP BY 1)
SELECT column_name, round(CAST(share AS DOUBLE), 6) AS share FROM s WHERE share <= 0.2"""


def select_trend_columns_(spark, sf):
    """Totals of the columns that get trends."""
    rows = panel_s(spark, sf)
    chosen = clean.select_trend_columns(rows, ["k", "p", "mi", "n"])
    sums = rows.agg(*[F.sum(c).alias(c) for c in chosen])
    return sums.unpivot([], chosen, "column_name", "total")


TREND_COLUMNS_SQL = with_(PANEL_S) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, sum({c}) AS total FROM panel_s" for c in "vmabr"
)


def encode_categorical_(spark, sf):
    """Codes learnt on orders before 1999, applied to all; unseen values share the last code."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    encoder = clean.categorical_encoder(orders.where(F.col("o_orderdate") < "1999-01-01"), ["o_orderpriority", "o_orderstatus"])
    return encoder.transform(orders).select(
        "o_orderkey", F.col("o_orderpriority_code").cast("int").alias("priority_code"), F.col("o_orderstatus_code").cast("int").alias("status_code")
    )


ENCODE_SQL = """
WITH early AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM early)),
s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM (SELECT DISTINCT o_orderstatus FROM early))
SELECT o_orderkey, CAST(coalesce(p.code, (SELECT count(*) FROM p)) AS INTEGER) AS priority_code,
       CAST(coalesce(s.code, (SELECT count(*) FROM s)) AS INTEGER) AS status_code
FROM orders LEFT JOIN p USING (o_orderpriority) LEFT JOIN s USING (o_orderstatus)"""


def assemble_pool_(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = labelled(spark, sf).withColumn("y", C.target_train(F.col("clase"))).na.fill(0.0, ["a", "b"])
    pool = clean.assemble_pool(rows, ["v", "a", "b"], "y", keep=["k", "p"])
    array = vector_to_array("features")
    return pool.select("k", "p", "label", F.size(array).alias("n_features"), *[array[i].alias(f"f{i}") for i in range(3)])


ASSEMBLE_SQL = with_(LABELLED) + """
SELECT k, p, CASE WHEN clase = 'CONTINUA' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label, CAST(3 AS INTEGER) AS n_features,
       v AS f0, coalesce(a, 0) AS f1, coalesce(b, 0) AS f2
FROM labelled"""


def reorder_column_(spark, sf):
    """Position of each column after the move, with the number of its values."""
    moved = clean.reorder_column(table(spark, sf, "orders"), "o_custkey")
    counts = moved.agg(*[F.count(c).alias(c) for c in moved.columns]).unpivot([], moved.columns, "column_name", "n_values")
    position = F.create_map(*[F.lit(x) for i, c in enumerate(moved.columns) for x in (c, i)])
    return counts.withColumn("position", position[F.col("column_name")])


REORDER_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_values, CAST({i} AS INTEGER) AS position FROM orders"
    for i, c in enumerate(("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey"))
)


def bin_age_(spark, sf):
    """Part sizes as ages; missing where the part's type is the largest."""
    age = F.when(F.col("p_type") != "ECONOMY", F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", C.bin_age(age + 6).alias("age_bin"))


BIN_AGE_SQL = """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN NULL WHEN p_size + 6 <= 18 THEN '(-Inf,18]' WHEN p_size + 6 <= 25 THEN '(18,25]'
  WHEN p_size + 6 <= 40 THEN '(25,40]' WHEN p_size + 6 <= 55 THEN '(40,55]' ELSE '(55, Inf]' END AS age_bin
FROM part"""


def _labels_without_newest(spark, sf):
    """Class per supplier month, unknown in the newest month."""
    rows = labelled(spark, sf)
    newest = rows.agg(F.max("p")).scalar()
    return rows.withColumn("clase", F.when(F.col("p") < newest, F.col("clase")))


UNLABELLED = LABELLED + """,
u AS (SELECT k, p, CASE WHEN p < (SELECT max(p) FROM labelled) THEN clase END AS clase FROM labelled)"""


def rescale_(spark, sf):
    rows = panel_c(spark, sf).select("k", "p", "t", "m")
    scaled = panel.rescale_features(rows, ["t"], digits=2)
    standard = panel.standardise_features(scaled, ["m"])
    return standard.withColumn("m", F.round("m", 6))


RESCALE_SQL = with_(PANEL_C) + """
SELECT k, p, round((max(t) OVER () - t) * 200.0::DOUBLE / nullif(max(t) OVER () - min(t) OVER (), 0) + -100.0::DOUBLE, 2) AS t,
       round((m - avg(m) OVER ()) / stddev_samp(m) OVER (), 6) AS m
FROM panel_c"""

QUERIES = {
    "days_to_snapshot": Query(days_to_snapshot_, DAYS_SQL),
    "relative_period": Query(relative_period_, RELATIVE_PERIOD_SQL),
    "substr_concat": Query(
        lambda spark, sf: panel_c(spark, sf).select("k", "p", P.date_text(F.col("p"), "15").alias("day")),
        with_(PANEL_C) + "SELECT k, p, substr(CAST(p AS VARCHAR), 1, 4) || '-' || substr(CAST(p AS VARCHAR), 5, 2) || '-15' AS day FROM panel_c",
    ),
    "join_periods": Query(
        _period_lists, with_(PANEL_C) + "SELECT k, string_agg(CAST(p AS VARCHAR), ', ' ORDER BY p) AS periods FROM panel_c GROUP BY k"
    ),
    "split_periods": Query(
        split_periods_,
        with_(PANEL_C) + "SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS INTEGER) AS pos, p FROM panel_c",
    ),
    "elapsed": Query(elapsed_, ELAPSED_SQL),
    "coalesce_zero": Query(_on_panel(lambda a, b, n: {"a0": C.coalesce_zero(a)}), _panel_sql("coalesce(a, 0) AS a0")),
    "row_sum_nullskip": Query(_on_panel(lambda a, b, n: {"total": C.row_sum_nullskip(a, b)}), _panel_sql("coalesce(a, 0) + coalesce(b, 0) AS total")),
    "row_max_min_nullskip": Query(
        _on_panel(lambda a, b, n: {"hi": C.row_max_nullskip(a, b), "lo": C.row_min_nullskip(a, b)}), _panel_sql("greatest(a, b) AS hi, least(a, b) AS lo")
    ),
    "row_mean": Query(row_mean_, ROW_MEAN_SQL),
    "ratio": Query(
        _on_panel(lambda a, b, n: {"part": C.safe_div(a, b), "signed": C.safe_div(a, n - 7, ieee=True)}),
        _panel_sql(
            "a / nullif(b, 0) AS part, CASE WHEN n = 7 THEN CASE WHEN a > 0 THEN 'inf'::DOUBLE WHEN a = 0 THEN 'nan'::DOUBLE END"
            " ELSE a / (n - 7) END AS signed"
        ),
    ),
    "guarded_ratio": Query(
        _on_panel(lambda a, b, n: {"part": C.guarded_ratio(a, b), "over_n": C.guarded_ratio(a, n - 7)}),
        _panel_sql(
            "CASE WHEN b IS NULL OR b = 0 THEN 0 ELSE a / b END AS part, CASE WHEN n = 7 THEN 0 ELSE a / (n - 7) END AS over_n"
        ),
    ),
    "null_sum": Query(_on_panel(lambda a, b, n: {"total": C.null_sum(a, b)}), _panel_sql("a + b AS total")),
    "complement": Query(
        lambda spark, sf: scores(spark, sf).select("id", C.complement(F.col("prob")).alias("rest")),
        with_(SCORES) + "SELECT id, 1 - prob AS rest FROM scores",
    ),
    "round_sign": Query(
        lambda spark, sf: scores(spark, sf).select(
            "id", F.round("prob", 5).alias("rounded"), C.sign(F.col("prob") - 0.5).alias("side")
        ),
        with_(SCORES) + "SELECT id, round(prob, 5) AS rounded, CAST(sign(prob - 0.5) AS DOUBLE) AS side FROM scores",
    ),
    "format_money": Query(
        lambda spark, sf: panel_c(spark, sf).select("k", "p", C.format_money(F.col("m")).alias("money"), C.format_money(-F.col("t")).alias("loss")),
        with_(PANEL_C) + "SELECT k, p, '$' || replace(format('{:,}', CAST(m AS BIGINT)), ',', '.') AS money,"
        " '$' || replace(format('{:,}', CAST(-t AS BIGINT)), ',', '.') AS loss FROM panel_c",
    ),
    "present_features": Query(present_features_, present_ctes() + "\nSELECT k, p, " + ", ".join(f.name for f in present_formulas()) + " FROM present"),
    "drop_columns": Query(drop_columns_, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"),
    "filter_period": Query(
        lambda spark, sf: clean.filter_period(panel_c(spark, sf), "p", 199706).select("k", "p", "t", "m"),
        with_(PANEL_C) + "SELECT k, p, t, m FROM panel_c WHERE p = 199706",
    ),
    "filter_in_list": Query(
        lambda spark, sf: clean.filter_in_list(
            clean.filter_in_list(panel_c(spark, sf), "p", [199706, 199705, 199801, 199612]), "t", [2, 3], negate=True
        ).select("k", "p", "t"),
        with_(PANEL_C) + "SELECT k, p, t FROM panel_c WHERE p IN (199706, 199705, 199801, 199612) AND t NOT IN (2, 3)",
    ),
    "filter_band": Query(
        lambda spark, sf: clean.filter_band(scores(spark, sf), "prob", 0.025, 0.5).select("id", "prob"),
        with_(SCORES) + "SELECT id, prob FROM scores WHERE prob >= 0.025 AND prob <= 0.5",
    ),
    "target_train": Query(
        lambda spark, sf: _labels_without_newest(spark, sf).select("k", "p", C.target_train(F.col("clase")).alias("target")),
        with_(UNLABELLED) + "SELECT k, p, CAST(CASE WHEN clase IS NULL THEN NULL WHEN clase = 'CONTINUA' THEN 0 ELSE 1 END AS INTEGER) AS target FROM u",
    ),
    "target_test": Query(
        lambda spark, sf: _labels_without_newest(spark, sf).select("k", "p", C.target_test(F.col("clase")).alias("target")),
        with_(UNLABELLED) + "SELECT k, p, CAST(CASE WHEN clase IS NULL THEN NULL WHEN clase = 'BAJA+2' THEN 1 ELSE 0 END AS INTEGER) AS target FROM u",
    ),
    "bin_age": Query(bin_age_, BIN_AGE_SQL),
    "fill_zero": Query(fill_zero_, _panel_sql("coalesce(a, 0) AS a, 0.0::DOUBLE AS from_nan")),
    "empty_to_null": Query(
        empty_to_null_,
        "SELECT o_orderkey, CASE WHEN instr(o_orderpriority, ' ') = 0 THEN o_orderpriority END AS priority,"
        " CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders",
    ),
    "strip_quotes": Query(strip_quotes_, "SELECT o_orderkey, o_orderpriority AS label FROM orders"),
    "drop_sparse_columns": Query(drop_sparse_columns_, DROP_SPARSE_SQL),
    "select_trend_columns": Query(select_trend_columns_, TREND_COLUMNS_SQL),
    "encode_categorical": Query(encode_categorical_, ENCODE_SQL),
    "assemble_pool": Query(assemble_pool_, ASSEMBLE_SQL),
    "reorder_column": Query(reorder_column_, REORDER_SQL),
    "rescale_feature": Query(rescale_, RESCALE_SQL),
}
