"""Joins, aggregates, sorting and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.catalog.panels import CURVE, FOLDS, folded
from tidepanel.catalog.views import (
    EXPERIMENTS, HYPERPARAMS, LABELLED, MODEL_SCORES, MODELS, PANEL_C, PANEL_S, PLANS, SCORES,
    Query, cents, experiments, hyperparams, labelled, model_scores, panel_c, panel_s, plans, scores, table, with_,
)
from tidepanel.functions.periods import period_of_date
from tidepanel.operators import clean, ensemble, evaluate, ledger, panel, profile, reconcile
from tidepanel.session import pinned

# --- joins --------------------------------------------------------------------


def _two_versions(spark, sf):
    """The sparse panel, and a second version of it in which large months were booked again with other counts.

    The panel is written once, as both versions are read from it, more than once by some queries.
    """
    left = pinned(panel_c(spark, sf).select("k", "p", F.nullif("t", F.lit(1)).alias("t"), "m"))
    again, kept = F.col("m") > 70_000_000, (F.col("m") <= 40_000_000) | (F.col("m") > 60_000_000)
    right = left.select("k", "p", "t", "m", F.explode(F.array(F.lit(False), F.lit(True))).alias("again"))
    right = right.where(F.when(F.col("again"), again).otherwise(kept))
    return left, right.select("k", "p", F.when(F.col("again"), F.lit(99)).otherwise(F.col("t")).alias("t"), "m")


TWO_VERSIONS = PANEL_C + """,
l AS (SELECT k, p, nullif(t, 1) AS t, m FROM panel_c),
r AS (SELECT * FROM l WHERE m <= 40000000 OR m > 60000000 UNION ALL SELECT k, p, 99, m FROM l WHERE m > 70000000)"""


def reconcile_anti_(spark, sf):
    left, right = _two_versions(spark, sf)
    return reconcile.reconcile_anti(left, right, "p")


def reconcile_by_hash_(spark, sf):
    left, right = _two_versions(spark, sf)
    return reconcile.reconcile_by_hash(left, right, "p")


RECONCILE_SQL = with_(TWO_VERSIONS) + """,
ll AS (SELECT p, count(*) AS n FROM l WHERE NOT EXISTS (
         SELECT 1 FROM r WHERE r.k = l.k AND r.p = l.p AND r.m = l.m AND r.t IS NOT DISTINCT FROM l.t) GROUP BY p),
rr AS (SELECT p, count(*) AS n FROM r WHERE NOT EXISTS (
         SELECT 1 FROM l WHERE r.k = l.k AND r.p = l.p AND r.m = l.m AND r.t IS NOT DISTINCT FROM l.t) GROUP BY p)
SELECT p, coalesce(ll.n, 0) AS only_left, coalesce(rr.n, 0) AS only_right
FROM (SELECT DISTINCT p FROM l) LEFT JOIN ll USING (p) LEFT JOIN rr USING (p)"""


def reconcile_rows_(spark, sf):
    left, right = _two_versions(spark, sf)
    return reconcile.rows_only_in_left(left, right)


RECONCILE_ROWS_SQL = with_(TWO_VERSIONS) + """
SELECT k, p, t, m, count(*) AS n_left FROM l WHERE NOT EXISTS (
  SELECT 1 FROM r WHERE r.k = l.k AND r.p = l.p AND r.m = l.m AND r.t IS NOT DISTINCT FROM l.t) GROUP BY ALL"""


def reconcile_types_(spark, sf):
    """Values of a label on either side once text and types agree."""
    orders = table(spark, sf, "orders")
    stored = orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"), F.col("o_custkey").alias("k"))
    filed = orders.select(F.regexp_replace("o_orderstatus", "P", "").alias("label"), F.col("o_custkey").cast("string").alias("k"))
    agreed = reconcile.reconcile_types(filed, stored, text_columns=["label"])
    assert not reconcile.compare_types(agreed, stored)
    return reconcile.compare_values(stored, agreed, "label")


RECONCILE_TYPES_SQL = """
SELECT nullif(o_orderstatus, 'P') AS label, count(*) AS n_left, count(*) AS n_right FROM orders GROUP BY 1"""


def ensemble_full_join_(spark, sf):
    return ensemble.ensemble_full_join(model_scores(spark, sf), MODELS)


FULL_JOIN = MODEL_SCORES + """,
wide AS (SELECT id, """ + ", ".join(f"max(prob) FILTER (model = {m}) AS prob_model_{m}" for m in MODELS) + """,
  max(class) FILTER (model = 464) AS class FROM model_scores GROUP BY id)"""

KEY_CHECK_SQL = with_(MODEL_SCORES) + ",\n" + ",\n".join(
    f"m{m} AS (SELECT id, class FROM model_scores WHERE model = {m})" for m in MODELS
) + "\n" + " UNION ALL ".join(
    f"SELECT CAST({m} AS INTEGER) AS model, count(*) FILTER (a.id IS NULL OR b.id IS NULL) AS n_key_diff,"
    f" count(*) FILTER (a.class <> b.class) AS n_class_diff FROM m{MODELS[0]} a FULL JOIN m{m} b ON a.id = b.id"
    for m in MODELS[1:]
)


def stacking_features_(spark, sf):
    wide = ensemble.stacking_features(ensemble_full_join_(spark, sf), MODELS)
    return wide.select("id", "prob_model_464_0", "prob_model_0_0", "prob_mean", F.round("prob_mean_0", 12).alias("prob_mean_0"))


_MEAN = "(" + " + ".join(f"prob_model_{m}" for m in MODELS) + ") / 6"
STACKING_FEATURES_SQL = with_(FULL_JOIN) + f"""
SELECT id, 1 - prob_model_464 AS prob_model_464_0, 1 - prob_model_0 AS prob_model_0_0, {_MEAN} AS prob_mean,
       round(1 - {_MEAN}, 12) AS prob_mean_0
FROM wide"""


def hyperparams_of_best_(spark, sf):
    params = ledger.hyperparams_long(hyperparams(spark, sf), "params")
    best = ledger.best_by_ratio(experiments(spark, sf))
    return ledger.hyperparams_of_best(params, best)


RATIO = "perfect_profit_ratio / nullif(logloss_testing, 0)"
BEST_BY_RATIO = EXPERIMENTS + f""",
best AS (SELECT * FROM (
  SELECT *, {RATIO} AS metric, row_number() OVER (PARTITION BY plan_id ORDER BY {RATIO} DESC, id) AS nth FROM experiments) WHERE nth = 1)"""


def panel_semi_anti_(spark, sf):
    return panel.panel_semi_anti(panel_c(spark, sf), "k", "p", 199706).select("k", "p", "t")


SEMI_ANTI_SQL = with_(PANEL_C) + """
SELECT k, p, t FROM panel_c WHERE k IN (SELECT k FROM panel_c GROUP BY k HAVING count(*) >= 4 OR bool_or(p = 199706))"""


def panel_gap_fill_(spark, sf):
    return panel.panel_gap_fill(panel_c(spark, sf), "k", "p", 199702).select("k", "p", "t", "m")


GAP_FILL_SQL = with_(PANEL_C) + """
SELECT k, p, t, m FROM panel_c
UNION ALL
SELECT c.k, CAST(w.p AS INTEGER), NULL, NULL FROM (SELECT DISTINCT k FROM panel_c WHERE p = 199702) c,
  (VALUES (199701), (199612), (199611)) AS w(p)
WHERE NOT EXISTS (SELECT 1 FROM panel_c h WHERE h.k = c.k AND h.p = w.p)"""


def align_columns_(spark, sf):
    """History columns beside the rows they belong to."""
    rows = panel_s(spark, sf)
    past = panel.history(rows, "k", "p", "v", {"prom": "avg", "maxi": "max"}, since=199709).select("k", "p", "prom", "maxi")
    return panel.align_columns(rows.select("k", "p", "n", "v"), past, "k", "p")


ALIGN_SQL = with_(PANEL_S) + """
SELECT t.k, t.p, any_value(t.n) AS n, any_value(t.v) AS v, avg(h.v) AS prom, max(h.v) AS maxi
FROM panel_s t LEFT JOIN panel_s h ON h.k = t.k AND h.p < t.p AND h.p > 199709 GROUP BY t.k, t.p"""


SWEEP = SCORES + """,
sweep AS (
  SELECT CAST(c.k AS INTEGER) AS k, c.k / 1000.0::DOUBLE AS cutoff, count(s.id) AS n_above,
         count(CASE WHEN s.class = 1 THEN 1 END) AS hits,
         CAST(coalesce(sum(CASE WHEN s.class = 1 THEN 11700 WHEN s.class = 0 THEN -300 END), 0) AS BIGINT) AS profit
  FROM range(0, 101) AS c(k) LEFT JOIN scores s ON s.prob > c.k / 1000.0::DOUBLE GROUP BY 1, 2)"""

# --- aggregates ---------------------------------------------------------------


def best_by_max_(spark, sf):
    return ledger.best_by_max(experiments(spark, sf)).select("plan_id", "id", "metric", "profit", "cutoff", "test_periods")


def best_by_min_(spark, sf):
    return ledger.best_by_min(experiments(spark, sf)).select("plan_id", "id", "metric", "profit", "cutoff", "test_periods")


def _best_sql(metric: str, direction: str) -> str:
    return with_(EXPERIMENTS) + f"""
SELECT plan_id, id, {metric} AS metric, profit, cutoff, test_periods FROM (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY {metric} {direction}, id) AS nth FROM experiments) WHERE nth = 1"""


def rows_at_group_max_(spark, sf):
    return ledger.rows_at_group_max(experiments(spark, sf)).select(
        "plan_id", "id", "profit", "cutoff", "perfect_profit_ratio", "train_periods", "test_periods", "experiment_code"
    )


ROWS_AT_MAX_SQL = with_(EXPERIMENTS, """placed AS (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY profit DESC, id) AS place FROM experiments)""") + """
SELECT plan_id, id, profit, cutoff, perfect_profit_ratio, train_periods, test_periods, experiment_code FROM placed WHERE place = 1"""


def box_stats_(spark, sf):
    return profile.box_stats(table(spark, sf, "documents"), "n_chars", "source")


BOX = """h AS (
  SELECT source, quantile_cont(n_chars, 0.25) AS lower, quantile_cont(n_chars, 0.5) AS middle, quantile_cont(n_chars, 0.75) AS upper
  FROM documents GROUP BY 1),
f AS (SELECT *, lower - (upper - lower) * 1.5 AS lo, upper + (upper - lower) * 1.5 AS hi FROM h),
d AS (SELECT documents.source, n_chars, lower, middle, upper, n_chars BETWEEN lo AND hi AS inside FROM documents JOIN f USING (source))"""
BOX_SQL = with_(BOX) + """
SELECT source, count(*) AS n, min(n_chars) FILTER (inside) AS whisker_low, max(lower) AS lower, max(middle) AS middle,
       max(upper) AS upper, max(n_chars) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers
FROM d GROUP BY 1"""


def confusion_(spark, sf):
    """Class by a rule that looks at the quantity only."""
    rows = labelled(spark, sf).withColumn("guess", F.when(F.col("v") > 250, "BAJA+1").when(F.col("v") > 200, "BAJA+2").otherwise("CONTINUA"))
    renamed = profile.confusion_matrix(rows, "clase", "guess", ["CONTINUA", "BAJA+1", "BAJA+2"])
    return renamed.withColumnsRenamed({"pred_CONTINUA": "pred_stays", "pred_BAJA+1": "pred_leaves1", "pred_BAJA+2": "pred_leaves2"})


CONFUSION_SQL = with_(LABELLED) + """
SELECT clase, count(*) FILTER (v <= 200) AS pred_stays, count(*) FILTER (v > 250) AS pred_leaves1,
       count(*) FILTER (v > 200 AND v <= 250) AS pred_leaves2
FROM labelled GROUP BY 1"""


def profile_schema_(spark, sf):
    return profile.profile_schema(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) AS n_rows, CAST(min({c}) AS VARCHAR) AS min_value,"
    f" CAST(max({c}) AS VARCHAR) AS max_value FROM orders"
    for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"))
)


def missing_profile_(spark, sf):
    return profile.missing_profile(panel_s(spark, sf), ["v", "a", "b", "r"]).withColumn("missing_share", F.round("missing_share", 9))


MISSING_SQL = with_(PANEL_S) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS missing_share FROM panel_s" for c in "vabr"
)


def class_counts_(spark, sf):
    """Overall (fold 0) and per fold."""
    rows = folded(spark, sf)
    whole = profile.class_counts(rows, "class").withColumn("fold", F.lit(0))
    return profile.class_counts(rows, "class", "fold").unionByName(whole)


CLASS_COUNTS_SQL = with_(FOLDS) + """
SELECT fold, class, count(*) AS n FROM folds GROUP BY ALL
UNION ALL SELECT CAST(0 AS INTEGER), class, count(*) FROM folds GROUP BY ALL"""


def perfect_profit_ratio_(spark, sf):
    """Best profit of the sweep against the perfect one, per month."""
    rows = scores(spark, sf)
    best = evaluate.best_cutoff(evaluate.cutoff_sweep(rows, by=["p"]), "min", by=["p"])
    return best.join(evaluate.perfect_profit(rows, by=["p"]), "p").select(
        "p", "profit", "perfect_profit", evaluate.profit_ratio(F.col("profit"), F.col("perfect_profit")).alias("ratio")
    )


PERFECT_RATIO_SQL = with_(SCORES) + """,
s AS (SELECT p, k, sum(CASE WHEN prob > k / 1000.0::DOUBLE THEN CASE WHEN class = 1 THEN 11700 ELSE -300 END ELSE 0 END) AS profit
      FROM scores, range(0, 101) AS c(k) GROUP BY 1, 2),
b AS (SELECT p, CAST(max(profit) AS BIGINT) AS profit FROM s GROUP BY 1),
f AS (SELECT p, count(*) FILTER (class = 1) * 11700 AS perfect_profit FROM scores GROUP BY 1)
SELECT p, profit, perfect_profit, round(profit::DOUBLE / nullif(perfect_profit, 0)::DOUBLE, 5) AS ratio FROM b JOIN f USING (p)"""


def best_cutoff_(spark, sf):
    """All three ways to settle ties, from one sweep."""
    sweep = pinned(evaluate.cutoff_sweep(scores(spark, sf)))
    return reduce(DataFrame.unionByName, [evaluate.best_cutoff(sweep, tie).withColumn("tie", F.lit(tie)) for tie in ("min", "max", "all")])


def auc_(spark, sf):
    """Over all rows (month 0) and per month."""
    rows = scores(spark, sf)
    whole = evaluate.auc(rows).withColumn("p", F.lit(0))
    return evaluate.auc(rows, by=["p"]).unionByName(whole).withColumn("auc", F.round("auc", 9))


AUC_SQL = with_(SCORES) + """,
twofold AS (SELECT p, prob, class FROM scores UNION ALL SELECT CAST(0 AS INTEGER), prob, class FROM scores),
r AS (SELECT p, class, rank() OVER (PARTITION BY p ORDER BY prob) + (count(*) OVER (PARTITION BY p, prob) - 1) / 2.0::DOUBLE AS rk FROM twofold),
s AS (SELECT p, count(*) AS n, count(*) FILTER (class = 1) AS n_pos, sum(rk) FILTER (class = 1) AS rks FROM r GROUP BY 1)
SELECT p, n, n_pos, round((rks - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos::DOUBLE * (n - n_pos), 0), 9) AS auc FROM s"""

_TERM = "-CASE WHEN class = 1 THEN ln(least(greatest(prob, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15)) END"


def metrics_over_repeats_(spark, sf):
    """Experiments of a plan as the repeats of one trial."""
    return evaluate.metrics_over_repeats(experiments(spark, sf), "plan_id", ["profit", "perfect_profit_ratio", "cutoff"], "minutes_taken", digits=None)


METRICS_SQL = with_(EXPERIMENTS) + """
SELECT plan_id, avg(profit) AS profit, avg(perfect_profit_ratio) AS perfect_profit_ratio,
       avg(cutoff) AS cutoff, round(sum(minutes_taken), 2) AS minutes_taken
FROM experiments GROUP BY 1"""


FOLD_SUMMARY_SQL = with_(FOLDS) + f""",
r AS (SELECT fold, class, rank() OVER (PARTITION BY fold ORDER BY prob) + (count(*) OVER (PARTITION BY fold, prob) - 1) / 2.0::DOUBLE AS rk FROM folds),
a AS (SELECT fold, (sum(rk) FILTER (class = 1) - count(*) FILTER (class = 1) * (count(*) FILTER (class = 1) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (class = 1) * count(*) FILTER (class = 0)) AS auc FROM r GROUP BY 1),
l AS (SELECT fold, avg({_TERM}) AS logloss, count(*) FILTER (class = 1) * 11700 AS perfect FROM folds GROUP BY 1),
c AS (SELECT fold, sum(CASE WHEN class = 1 THEN 11700 ELSE -300 END) OVER (PARTITION BY fold ORDER BY prob DESC, id ROWS UNBOUNDED PRECEDING) AS acum FROM folds),
t AS (SELECT fold, max(acum)::DOUBLE AS top FROM c GROUP BY 1)
SELECT count(*) AS n_folds, round(avg(auc), 5) AS auc, round(avg(logloss), 5) AS logloss, round(avg(top / perfect), 2) AS profit_ratio,
       round(avg(top / perfect * (SELECT count(*) FILTER (class = 1) * 11700 FROM folds)), 0) AS profit
FROM a JOIN l USING (fold) JOIN t USING (fold)"""


def _band(spark, sf):
    curve = evaluate.profit_curve(scores(spark, sf))
    return evaluate.prob_in_profit_band(curve).withColumn("cutoff", F.round("cutoff", 9))


# --- sorting, limits, sets ----------------------------------------------------


def _listed(df):
    """Keep the wanted columns of a sorted listing."""
    return df.select("test_periods", "id", "metric", "cutoff", "train_periods", "plan_id")


def union_periods_(spark, sf):
    """Months put under each other."""
    rows = panel_c(spark, sf).select("k", "p", "t")
    return clean.filter_period(rows, "p", 199706).unionByName(clean.filter_period(rows, "p", 199705))


def union_fill_(spark, sf):
    """Customers' and suppliers' months in one table; a column of one side only is null on the other."""
    return panel_c(spark, sf).select("k", "p", "t").unionByName(panel_s(spark, sf).select("k", "p", "v"), allowMissingColumns=True)


def wide_to_long_(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.sum(F.when(F.col("o_orderstatus") == "O", cents("o_totalprice"))).alias("open_cents"),
        F.sum(F.when(F.col("o_orderstatus") == "F", cents("o_totalprice"))).alias("done_cents"),
    )
    return profile.wide_to_long(sums, ["o_orderpriority"], ["open_cents", "done_cents"], "kind", "cents")


WIDE_TO_LONG_SQL = """
SELECT o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 'open_cents' ELSE 'done_cents' END AS kind,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2"""


def downsample_(spark, sf):
    return ensemble.downsample_majority(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "en", "doc_id", ratio=0.25)


DOWNSAMPLE_SQL = """
WITH o AS (SELECT doc_id, lang FROM documents WHERE lang <> 'en'),
m AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-1')), doc_id) AS n FROM documents WHERE lang = 'en')
SELECT doc_id, lang FROM o UNION ALL SELECT doc_id, lang FROM m WHERE n <= (SELECT round(count(*) * 0.25::DOUBLE) FROM o)"""


def oversample_(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    drawn = ensemble.oversample_minority(labels, "quality", 0, "doc_id", times=50)
    return drawn.groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("copies"))


OVERSAMPLE_SQL = """
WITH s AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE quality = 0),
d AS (SELECT CAST('0x' || substr(md5(concat(CAST(doc_id AS VARCHAR), '-', CAST(i AS VARCHAR), '-1')), 1, 15) AS BIGINT)
             % (SELECT count(*) FROM s) + 1 AS n FROM s, range(1, 51) AS r(i)),
u AS (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM d JOIN s USING (n))
SELECT doc_id, quality, count(*) AS copies FROM u GROUP BY ALL"""

QUERIES = {
    "reconcile_anti": Query(reconcile_anti_, RECONCILE_SQL),
    "reconcile_by_hash": Query(reconcile_by_hash_, RECONCILE_SQL),
    "reconcile_rows": Query(reconcile_rows_, RECONCILE_ROWS_SQL),
    "reconcile_types": Query(reconcile_types_, RECONCILE_TYPES_SQL),
    "ensemble_full_join": Query(ensemble_full_join_, with_(FULL_JOIN) + "SELECT * FROM wide"),
    "ensemble_key_check": Query(
        lambda spark, sf: ensemble.ensemble_key_check(model_scores(spark, sf), MODELS), KEY_CHECK_SQL
    ),
    "stacking_features": Query(stacking_features_, STACKING_FEATURES_SQL),
    "hyperparams_of_best": Query(
        hyperparams_of_best_,
        with_(BEST_BY_RATIO, HYPERPARAMS)
        + "SELECT h.experiment_id, h.name, h.value, b.test_periods, b.train_periods, b.metric FROM hyperparams h JOIN best b ON b.id = h.experiment_id",
    ),
    "panel_semi_anti": Query(panel_semi_anti_, SEMI_ANTI_SQL),
    "panel_gap_fill": Query(panel_gap_fill_, GAP_FILL_SQL),
    "align_columns": Query(align_columns_, ALIGN_SQL),
    "cutoff_cross": Query(
        lambda spark, sf: evaluate.cutoff_sweep(scores(spark, sf)).select("k", "n_above", "hits"),
        with_(SWEEP) + "SELECT k, n_above, hits FROM sweep",
    ),
    "count_by_key": Query(
        lambda spark, sf: panel.count_by_key(panel_c(spark, sf), "k"), with_(PANEL_C) + "SELECT k, count(*) AS count FROM panel_c GROUP BY k"
    ),
    "incomplete_keys": Query(
        lambda spark, sf: panel.incomplete_keys(panel_c(spark, sf), "k", 10),
        with_(PANEL_C) + "SELECT k FROM panel_c GROUP BY k HAVING count(*) < 10",
    ),
    "avg_global": Query(
        lambda spark, sf: panel_c(spark, sf).agg(F.avg("m").alias("mean")), with_(PANEL_C) + "SELECT avg(m) AS mean FROM panel_c"
    ),
    "avg_by_group": Query(
        lambda spark, sf: ledger.avg_by_group(experiments(spark, sf)),
        with_(EXPERIMENTS) + "SELECT test_periods, round(avg(cutoff), 3) AS avg_cutoff FROM experiments GROUP BY 1",
    ),
    "best_by_max": Query(best_by_max_, _best_sql("perfect_profit_ratio", "DESC")),
    "best_by_min": Query(best_by_min_, _best_sql("logloss_testing", "ASC")),
    "best_by_ratio": Query(
        lambda spark, sf: _listed(ledger.best_by_ratio(experiments(spark, sf))),
        with_(BEST_BY_RATIO) + "SELECT test_periods, id, metric, cutoff, train_periods, plan_id FROM best ORDER BY test_periods, metric DESC, id",
    ),
    "metric_listing": Query(
        lambda spark, sf: _listed(ledger.metric_listing(experiments(spark, sf))),
        with_(EXPERIMENTS) + f"SELECT test_periods, id, round({RATIO}, 2) AS metric, cutoff, train_periods, plan_id FROM experiments",
    ),
    "rows_at_group_max": Query(rows_at_group_max_, ROWS_AT_MAX_SQL),
    "class_distribution": Query(
        lambda spark, sf: profile.class_distribution(labelled(spark, sf), "clase"),
        with_(LABELLED) + "SELECT clase, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labelled), 4) AS percent FROM labelled GROUP BY 1",
    ),
    "class_counts": Query(class_counts_, CLASS_COUNTS_SQL),
    "confusion_matrix": Query(confusion_, CONFUSION_SQL),
    "missing_profile": Query(missing_profile_, MISSING_SQL),
    "box_stats": Query(box_stats_, BOX_SQL),
    "box_outliers": Query(
        lambda spark, sf: profile.box_outliers(table(spark, sf, "documents"), "n_chars", "source"),
        with_(BOX) + "SELECT source, n_chars FROM d WHERE NOT inside",
    ),
    "profile_schema": Query(profile_schema_, PROFILE_SQL),
    "distinct_values": Query(
        lambda spark, sf: profile.distinct_values(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"),
        "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    ),
    "profit_at_cutoff": Query(
        lambda spark, sf: evaluate.profit_at_cutoff(scores(spark, sf), 0.025).unionByName(
            evaluate.profit_at_cutoff(scores(spark, sf), 0.025, gain=11000)
        ),
        with_(SCORES) + """
SELECT CAST(sum(CASE WHEN prob > 0.025 THEN CASE WHEN class = 1 THEN g ELSE -300 END ELSE 0 END) AS BIGINT) AS profit
FROM scores, (VALUES (11700), (11000)) AS gains(g) GROUP BY g""",
    ),
    "cutoff_sweep": Query(
        lambda spark, sf: evaluate.cutoff_sweep(scores(spark, sf)).select("k", "cutoff", "profit"),
        with_(SWEEP) + "SELECT k, cutoff, profit FROM sweep",
    ),
    "best_cutoff": Query(
        best_cutoff_,
        with_(SWEEP) + """, top AS (SELECT * FROM sweep WHERE profit = (SELECT max(profit) FROM sweep))
SELECT min(cutoff) AS cutoff, max(profit) AS profit, 'min' AS tie FROM top
UNION ALL SELECT max(cutoff), max(profit), 'max' FROM top UNION ALL SELECT cutoff, profit, 'all' FROM top""",
    ),
    "profit_default_cutoff": Query(
        lambda spark, sf: evaluate.profit_default_cutoff(evaluate.cutoff_sweep(scores(spark, sf))),
        with_(SWEEP) + "SELECT cutoff, profit FROM sweep WHERE k = 25",
    ),
    "perfect_profit": Query(
        lambda spark, sf: evaluate.perfect_profit(scores(spark, sf)),
        with_(SCORES) + "SELECT CAST(sum(class) * 11700 AS BIGINT) AS perfect_profit FROM scores",
    ),
    "perfect_profit_ratio": Query(perfect_profit_ratio_, PERFECT_RATIO_SQL),
    "auc": Query(auc_, AUC_SQL),
    "logloss": Query(
        lambda spark, sf: evaluate.logloss(scores(spark, sf), by=["p"]).withColumn("logloss", F.round("logloss", 9)),
        with_(SCORES) + f"SELECT p, round(avg({_TERM}), 9) AS logloss FROM scores GROUP BY 1",
    ),
    "metrics_over_repeats": Query(metrics_over_repeats_, METRICS_SQL),
    "fold_summary": Query(lambda spark, sf: evaluate.fold_summary(evaluate.fold_metrics(pinned(folded(spark, sf)))), FOLD_SUMMARY_SQL),
    "counts_at_best": Query(
        lambda spark, sf: evaluate.counts_at_best(evaluate.profit_curve(scores(spark, sf))),
        with_(CURVE) + """, best AS (SELECT arg_max(prob, -rank) AS prob FROM curve WHERE profit_acum = (SELECT max(profit_acum) FROM curve))
SELECT count(*) AS n, count(*) FILTER (class = 1) AS hits, count(*) FILTER (class = 0) AS misses FROM curve WHERE prob >= (SELECT prob FROM best)""",
    ),
    "prob_in_profit_band": Query(
        _band,
        with_(CURVE) + "SELECT round(avg(prob), 9) AS cutoff, count(*) AS n FROM curve WHERE profit_acum BETWEEN 7490000 AND 7510000",
    ),
    "filter_pending_plan": Query(
        lambda spark, sf: ledger.filter_pending_plan(plans(spark, sf)).select("id", "train", "test"),
        with_(PLANS) + "SELECT id, train, test FROM plans WHERE finished IS NULL",
    ),
    "next_plan": Query(
        lambda spark, sf: ledger.next_plan(plans(spark, sf)).select("id", "train", "test"),
        with_(PLANS) + "SELECT id, train, test FROM plans WHERE finished IS NULL ORDER BY id LIMIT 1",
    ),
    "sort_panel": Query(
        lambda spark, sf: panel_c(spark, sf).select("k", "p", "t").orderBy("k", "p"), with_(PANEL_C) + "SELECT k, p, t FROM panel_c ORDER BY k, p"
    ),
    "sort_metric": Query(
        lambda spark, sf: experiments(spark, sf).select("test_periods", "id", "cutoff").orderBy("test_periods", F.col("cutoff").desc(), "id"),
        with_(EXPERIMENTS) + "SELECT test_periods, id, cutoff FROM experiments ORDER BY test_periods, cutoff DESC, id",
    ),
    "experiments_of_plan": Query(
        lambda spark, sf: ledger.experiments_of_plan(experiments(spark, sf), 7).select("plan_id", "id", "profit", "test_periods"),
        with_(EXPERIMENTS) + "SELECT plan_id, id, profit, test_periods FROM experiments WHERE plan_id = 7 ORDER BY profit DESC, id",
    ),
    "top_n_ids": Query(
        lambda spark, sf: ensemble.top_n_ids(scores(spark, sf)), with_(SCORES) + "SELECT id, prob FROM scores ORDER BY prob DESC, id LIMIT 7664"
    ),
    "union_periods": Query(union_periods_, with_(PANEL_C) + "SELECT k, p, t FROM panel_c WHERE p IN (199706, 199705)"),
    "union_fill": Query(
        union_fill_,
        with_(PANEL_C, PANEL_S) + "SELECT k, p, t, NULL::DOUBLE AS v FROM panel_c UNION ALL SELECT k, p, NULL, v FROM panel_s",
    ),
    "set_difference": Query(
        lambda spark, sf: panel.set_difference(
            table(spark, sf, "orders").select(F.col("o_custkey").alias("k")),
            table(spark, sf, "orders").where(F.col("o_orderdate") >= "2000-12-01").select(F.col("o_custkey").alias("k")),
            "k",
        ),
        "SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-12-01'",
    ),
    "distinct_periods": Query(
        lambda spark, sf: table(spark, sf, "orders").select(period_of_date(F.col("o_orderdate")).alias("p")).distinct(),
        "SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS p FROM orders",
    ),
    "wide_to_long": Query(wide_to_long_, WIDE_TO_LONG_SQL),
    "downsample_majority": Query(downsample_, DOWNSAMPLE_SQL),
    "oversample_minority": Query(oversample_, OVERSAMPLE_SQL),
}
