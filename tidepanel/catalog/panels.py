"""Panel, trend and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.views import (
    EXPERIMENTS, PANEL_C, PANEL_S, SCORES, Query, cents, experiments, panel_c, panel_s, scores, table, with_,
)
from tidepanel.functions.periods import backward_months, period_of_date
from tidepanel.operators import ensemble, evaluate, ledger, panel
from tidepanel.operators.between import history_between
from tidepanel.plans.months import MonthStore
from tidepanel.session import scratch_path

# Values of three months ago to now, by joins on the month count.
LAGS_C = PANEL_C + """,
lags AS (
  SELECT t.*, coalesce(l3.m, 0) AS y0, coalesce(l2.m, 0) AS y1, coalesce(l1.m, 0) AS y2, t.m AS y3
  FROM panel_c t
  LEFT JOIN panel_c l1 ON l1.k = t.k AND l1.mi = t.mi - 1
  LEFT JOIN panel_c l2 ON l2.k = t.k AND l2.mi = t.mi - 2
  LEFT JOIN panel_c l3 ON l3.k = t.k AND l3.mi = t.mi - 3),
spans AS (SELECT *, greatest(y0, y1, y2, y3) AS hi, least(y0, y1, y2, y3) AS lo FROM lags)"""

GROWTH_POLY = "(-2 * y0 + 9 * y1 - 18 * y2 + 11 * y3) / 6 * (hi - lo)"
GROWTH_FINDIFF = "(y2 - 4 * y1 + 3 * y0) / 2 * (hi - lo)"
ACCEL_POLY = "(-y0 + 4 * y1 - 5 * y2 + 2 * y3) / nullif(hi - lo, 0)"
ACCEL_FINDIFF = "(-y3 + 4 * y2 - 5 * y1 + 2 * y0) / nullif(hi - lo, 0)"
CATEGORY_POLY = f"CAST(sign(sign({ACCEL_POLY}) + sign({GROWTH_POLY})) AS DOUBLE)"
CATEGORY_FINDIFF = f"CAST(sign(sign({ACCEL_FINDIFF}) + sign({GROWTH_FINDIFF})) AS DOUBLE)"
RELATIVE = "(y2 - y3) / nullif(y2, 0)"

_OFF = dict.fromkeys(("growth_poly", "growth_findiff", "accel_poly", "accel_findiff", "trend_relative"), False)


def _only(**flags) -> panel.PanelSpec:
    return panel.PanelSpec(key="k", period="p", features=("m",), **{**_OFF, **flags})


def _feature(column: str, spec: panel.PanelSpec):
    """One feature over the whole sparse panel."""
    return lambda spark, sf: panel.panel_features(panel_c(spark, sf), spec).select("k", "p", F.col(column).alias("feature"))


def _feature_sql(expression: str) -> str:
    return with_(LAGS_C) + f"SELECT k, p, {expression} AS feature FROM spans"


def backward_months_(spark, sf):
    periods = table(spark, sf, "orders").select(period_of_date(F.col("o_orderdate")).alias("p")).distinct()
    return periods.select("p", F.explode(backward_months(F.col("p"), 3)).alias("month"))


BACKWARD_SQL = """
WITH d AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS f FROM orders)
SELECT CAST(strftime(f, '%Y%m') AS INTEGER) AS p, CAST(strftime(f - to_months(CAST(j AS INTEGER)), '%Y%m') AS INTEGER) AS month
FROM d, range(0, 4) AS r(j)"""


def panel_lags_(spark, sf):
    lags = panel.panel_lags(panel_c(spark, sf), "k", "p", ["m", "t"])
    return lags.select("k", "p", *[F.col(f"{c}__y{i}").alias(f"{c}_y{i}") for c in ("m", "t") for i in range(4)])


PANEL_LAGS_SQL = with_(PANEL_C) + """
SELECT t.k, t.p, coalesce(l3.m, 0) AS m_y0, coalesce(l2.m, 0) AS m_y1, coalesce(l1.m, 0) AS m_y2, t.m AS m_y3,
       CAST(coalesce(l3.t, 0) AS DOUBLE) AS t_y0, CAST(coalesce(l2.t, 0) AS DOUBLE) AS t_y1,
       CAST(coalesce(l1.t, 0) AS DOUBLE) AS t_y2, CAST(t.t AS DOUBLE) AS t_y3
FROM panel_c t
LEFT JOIN panel_c l1 ON l1.k = t.k AND l1.mi = t.mi - 1
LEFT JOIN panel_c l2 ON l2.k = t.k AND l2.mi = t.mi - 2
LEFT JOIN panel_c l3 ON l3.k = t.k AND l3.mi = t.mi - 3"""


def panel_max_min_(spark, sf):
    made = panel.panel_features(panel_c(spark, sf), _only(max_min=True))
    return made.select("k", "p", F.col("m__MAX").alias("largest"), F.col("m__MIN").alias("smallest"))


def salary_flag_(spark, sf):
    spec = panel.PanelSpec(key="k", period="p", features=(), salary="a", **{**_OFF, "max_min": True})
    return panel.panel_features(panel_s(spark, sf), spec).select("k", "p", F.col("dependencia_salarial").alias("flag"))


SALARY_SQL = with_(PANEL_S) + """
SELECT t.k, t.p, CAST(CASE WHEN coalesce(t.a, 0) + coalesce(l1.a, 0) + coalesce(l2.a, 0) + coalesce(l3.a, 0) > 0
                           THEN 1 ELSE 0 END AS INTEGER) AS flag
FROM panel_s t
LEFT JOIN panel_s l1 ON l1.k = t.k AND l1.mi = t.mi - 1
LEFT JOIN panel_s l2 ON l2.k = t.k AND l2.mi = t.mi - 2
LEFT JOIN panel_s l3 ON l3.k = t.k AND l3.mi = t.mi - 3"""


ALL_TRENDS = panel.PanelSpec(key="k", period="p", features=("m",), max_min=True, salary="t")


def panel_append_(spark, sf):
    """All but the newest three months at once, then these one after the other."""
    rows = panel_c(spark, sf).drop("mi")
    # One row per month.
    months = [r["p"] for r in rows.select("p").distinct().orderBy("p").collect()]
    store = MonthStore(spark, scratch_path(spark, "months"), ALL_TRENDS, rows.schema)
    for periods in (months[:-3], *[[p] for p in months[-3:]]):
        if periods:
            store.append(rows, periods)
    return _named_trends(store.features())


def panel_features_(spark, sf):
    return _named_trends(panel.panel_features(panel_c(spark, sf), ALL_TRENDS))


def _named_trends(made):
    names = {
        "m__MAX": "hi", "m__MIN": "lo", "m__CREC_POLI": "growth_poly", "m__CREC_DIFINI": "growth_findiff",
        "m__ACEL_POLI": "accel_poly", "m__ACEL_DIFINI": "accel_findiff", "m__ACEL_POLI__CAT_POLI": "category",
        "m__ANDREU": "relative", "dependencia_salarial": "flag",
    }
    return made.select("k", "p", "t", "m", *[F.col(c).alias(name) for c, name in names.items()])


PANEL_FEATURES_SQL = with_(LAGS_C) + f"""
SELECT k, p, t, m, hi, lo, {GROWTH_POLY} AS growth_poly, {GROWTH_FINDIFF} AS growth_findiff,
       {ACCEL_POLY} AS accel_poly, {ACCEL_FINDIFF} AS accel_findiff, {CATEGORY_POLY} AS category,
       {RELATIVE} AS relative, CAST(1 AS INTEGER) AS flag
FROM spans"""


def _history(measures, value="v", **options):
    return lambda spark, sf: panel.history(panel_s(spark, sf), "k", "p", value, measures, **options).select("k", "p", *measures)


def _history_sql(expression: str, name: str, low: str, high: str = "h.mi < t.mi") -> str:
    return with_(PANEL_S) + f"""
SELECT t.k, t.p, {expression} AS {name}
FROM panel_s t LEFT JOIN panel_s h ON h.k = t.k AND {high} AND {low}
GROUP BY t.k, t.p"""


def history_theta_join_(spark, sf):
    """All earlier months after a fixed bound."""
    made = panel.history(panel_c(spark, sf), "k", "p", "m", {"prom": "avg", "maxi": "max"}, since=199706)
    return made.select("k", "p", "prom", "maxi")


HISTORY_THETA_SQL = with_(PANEL_C) + """
SELECT t.k, t.p, avg(h.m) AS prom, max(h.m) AS maxi
FROM panel_c t LEFT JOIN panel_c h ON h.k = t.k AND h.p < t.p AND h.p > 199706
GROUP BY t.k, t.p"""


def history_window_open_(spark, sf):
    return panel.history_open(panel_s(spark, sf), "k", "p", "v", {"prom": "avg", "maxi": "max"}).select("k", "p", "prom", "maxi")


def history_avg_(spark, sf):
    """Plain mean and the mean that takes missing values as 0."""
    rows = panel_s(spark, sf)
    plain = panel.history(rows, "k", "p", "r", {"plain": "avg"})
    return panel.history(plain, "k", "p", "r", {"zeroed": "avg"}, null_as_zero=True).select("k", "p", "plain", "zeroed")


HISTORY_AVG_SQL = with_(PANEL_S) + """
SELECT t.k, t.p, avg(h.r) AS plain, avg(CASE WHEN h.k IS NOT NULL THEN coalesce(h.r, 0) END) AS zeroed
FROM panel_s t LEFT JOIN panel_s h ON h.k = t.k AND h.mi < t.mi AND h.mi >= t.mi - 6
GROUP BY t.k, t.p"""


def interpolate_gaps_(spark, sf):
    lags = panel.panel_lags(panel_c(spark, sf), "k", "p", ["m"], fill="interpolate")
    return lags.select("k", "p", *[F.col(f"m__y{i}").alias(f"y{i}") for i in range(4)])


INTERPOLATE_SQL = with_(PANEL_C) + """,
raw AS (
  SELECT t.k, t.p, l3.m AS r0, l2.m AS r1, l1.m AS r2, t.m AS r3 FROM panel_c t
  LEFT JOIN panel_c l1 ON l1.k = t.k AND l1.mi = t.mi - 1
  LEFT JOIN panel_c l2 ON l2.k = t.k AND l2.mi = t.mi - 2
  LEFT JOIN panel_c l3 ON l3.k = t.k AND l3.mi = t.mi - 3),
ends AS (SELECT *, coalesce(r0, r1, 0) AS y0, coalesce(r3, r2, 0) AS y3 FROM raw),
second AS (SELECT *, coalesce(r1, (y0 + r2) / 2) AS y1 FROM ends)
SELECT k, p, y0, y1, coalesce(r2, (y1 + y3) / 2) AS y2, y3 FROM second"""


def profit_curve_(spark, sf):
    curve = evaluate.profit_curve(scores(spark, sf))
    return curve.select("id", "prob", "class", "rank", "profit_acum")


CURVE = SCORES + """,
curve AS (
  SELECT id, prob, class, row_number() OVER w AS rank,
         CAST(sum(CASE WHEN class = 1 THEN 11700 ELSE -300 END) OVER w AS BIGINT) AS profit_acum
  FROM scores WINDOW w AS (ORDER BY prob DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def profit_curve_peak_(spark, sf):
    return evaluate.profit_curve_peak(evaluate.profit_curve(scores(spark, sf), by=["p"]), by=["p"])


PEAK_SQL = with_(SCORES) + """,
c AS (SELECT p, prob, row_number() OVER w AS rank,
             CAST(sum(CASE WHEN class = 1 THEN 11700 ELSE -300 END) OVER w AS BIGINT) AS profit_acum
      FROM scores WINDOW w AS (PARTITION BY p ORDER BY prob DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY profit_acum DESC, rank) AS nth FROM c)
SELECT p, rank, prob, profit_acum FROM r WHERE nth = 1"""


def profit_curve_peak_rows_(spark, sf):
    curve = evaluate.profit_curve(scores(spark, sf))
    return evaluate.profit_curve_peak_rows(curve).select("id", "prob", "rank", "profit_acum")


def search_evolution_(spark, sf):
    return ledger.search_evolution(experiments(spark, sf)).select(
        "plan_id", "id", F.round("hours", 6).alias("hours"), "best_profit"
    )


EVOLUTION_SQL = with_(EXPERIMENTS) + """
SELECT plan_id, id, round(sum(minutes_taken / 60) OVER w, 6) AS hours, max(profit) OVER w AS best_profit
FROM experiments
WINDOW w AS (PARTITION BY plan_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

FOLDS = SCORES + """,
folds AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY class ORDER BY md5(concat(CAST(id AS VARCHAR), '-1')), id) - 1) * 10
                 // count(*) OVER (PARTITION BY class) + 1 AS INTEGER) AS fold
  FROM scores)"""


def folded(spark, sf):
    return ensemble.stratified_folds(scores(spark, sf), "class", "id")


def fold_split_(spark, sf):
    """Size and hits of both sides of the first split."""
    sides = zip(("train", "test"), ensemble.fold_split(folded(spark, sf), 1))
    parts = [
        side.agg(F.count(F.lit(1)).alias("n"), F.sum("class").alias("hits")).withColumn("side", F.lit(name)) for name, side in sides
    ]
    return parts[0].unionByName(parts[1])


FOLD_SPLIT_SQL = with_(FOLDS) + """
SELECT CASE WHEN fold = 1 THEN 'test' ELSE 'train' END AS side, count(*) AS n, CAST(sum(class) AS BIGINT) AS hits
FROM folds GROUP BY 1"""

HOUR = 3_600_000_000


def _micros(ts: str):
    """Microseconds since 1970, whatever the session's time zone."""
    days = F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")
    return days * (24 * HOUR) + minutes * (HOUR // 60) + seconds


def history_between_(spark, sf):
    """For each event the user's earlier ones, as far back as one hour to three days and up to four minutes before: each row has its own bounds."""
    events = table(spark, sf, "events").select("event_id", "user_id", _micros("ts").alias("t"), cents("value").alias("v"))
    back, gap = (F.col("event_id") % 72 + 1) * HOUR, F.col("event_id") % 5 * (HOUR // 60)
    return history_between(
        events, events, ["event_id"], "user_id", F.col("t") - back, F.col("t") - gap, F.col("t"), F.col("v"),
        {"n": "count", "total": "sum", "mean": "avg", "most": "max", "least": "min"}, width=6 * HOUR,
    )


HISTORY_BETWEEN_SQL = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events)
SELECT a.event_id, count(b.v) AS n, CAST(sum(b.v) AS BIGINT) AS total, CAST(sum(b.v) AS DOUBLE) / nullif(count(b.v), 0) AS mean, max(b.v) AS most, min(b.v) AS least
FROM e AS a LEFT JOIN e AS b ON b.user_id = a.user_id AND b.t > a.t - (a.event_id % 72 + 1) * 3600000000 AND b.t < a.t - a.event_id % 5 * 60000000
GROUP BY a.event_id"""

QUERIES = {
    "history_between": Query(history_between_, HISTORY_BETWEEN_SQL),
    "backward_months": Query(backward_months_, BACKWARD_SQL),
    "panel_lags": Query(panel_lags_, PANEL_LAGS_SQL),
    "salary_flag": Query(salary_flag_, SALARY_SQL),
    "panel_max_min": Query(panel_max_min_, with_(LAGS_C) + "SELECT k, p, hi AS largest, lo AS smallest FROM spans"),
    "growth_poly": Query(_feature("m__CREC_POLI", _only(growth_poly=True)), _feature_sql(GROWTH_POLY)),
    "growth_findiff": Query(_feature("m__CREC_DIFINI", _only(growth_findiff=True)), _feature_sql(GROWTH_FINDIFF)),
    "accel_poly": Query(_feature("m__ACEL_POLI", _only(accel_poly=True)), _feature_sql(ACCEL_POLY)),
    "accel_findiff": Query(_feature("m__ACEL_DIFINI", _only(accel_findiff=True)), _feature_sql(ACCEL_FINDIFF)),
    "trend_category": Query(
        _feature("m__ACEL_POLI__CAT_POLI", _only(accel_poly=True, growth_poly=True)), _feature_sql(CATEGORY_POLY)
    ),
    "trend_category_findiff": Query(
        _feature("m__CREC_DIFINI__CAT_DIFINI", _only(accel_findiff=True, growth_findiff=True, category_findiff=True)),
        _feature_sql(CATEGORY_FINDIFF),
    ),
    "trend_relative": Query(_feature("m__ANDREU", _only(trend_relative=True)), _feature_sql(RELATIVE)),
    "panel_features": Query(panel_features_, PANEL_FEATURES_SQL),
    "panel_append": Query(panel_append_, PANEL_FEATURES_SQL),
    "history_theta_join": Query(history_theta_join_, HISTORY_THETA_SQL),
    "history_avg": Query(history_avg_, HISTORY_AVG_SQL),
    "history_max": Query(_history({"maxi": "max"}), _history_sql("max(h.v)", "maxi", "h.mi >= t.mi - 6")),
    "history_stddev": Query(
        lambda spark, sf: panel.history(panel_s(spark, sf), "k", "p", "v", {"sd": "stddev_pop"}).select(
            "k", "p", F.round("sd", 6).alias("sd")
        ),
        _history_sql("round(stddev_pop(h.v), 6)", "sd", "h.mi >= t.mi - 6"),
    ),
    "history_window": Query(
        _history({"avg6": "avg"}, value="r", null_as_zero=True),
        _history_sql("avg(CASE WHEN h.k IS NOT NULL THEN coalesce(h.r, 0) END)", "avg6", "h.mi >= t.mi - 6"),
    ),
    "history_avg3": Query(
        _history({"avg3": "avg"}, value="r", null_as_zero=True, first=-3),
        _history_sql("avg(CASE WHEN h.k IS NOT NULL THEN coalesce(h.r, 0) END)", "avg3", "h.mi >= t.mi - 3"),
    ),
    "history_window_open": Query(
        history_window_open_, _history_sql("avg(h.v) AS prom, max(h.v)", "maxi", "h.mi > t.mi - 6")
    ),
    "interpolate_gaps": Query(interpolate_gaps_, INTERPOLATE_SQL),
    "profit_curve": Query(profit_curve_, with_(CURVE) + "SELECT id, prob, class, rank, profit_acum FROM curve"),
    "profit_curve_peak": Query(profit_curve_peak_, PEAK_SQL),
    "profit_curve_peak_rows": Query(
        profit_curve_peak_rows_,
        with_(CURVE) + "SELECT id, prob, rank, profit_acum FROM curve WHERE profit_acum = (SELECT max(profit_acum) FROM curve)",
    ),
    "search_evolution": Query(search_evolution_, EVOLUTION_SQL),
    "stratified_folds": Query(
        lambda spark, sf: folded(spark, sf).select("id", "class", "fold"), with_(FOLDS) + "SELECT id, class, fold FROM folds"
    ),
    "fold_split": Query(fold_split_, FOLD_SPLIT_SQL),
    "rank_ids": Query(
        lambda spark, sf: ensemble.rank_ids(scores(spark, sf)).select("id", "rank"),
        with_(SCORES) + "SELECT id, row_number() OVER (ORDER BY prob DESC, id) AS rank FROM scores",
    ),
}
