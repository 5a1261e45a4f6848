"""The whole way from snapshot rows to a table for learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.panels import ACCEL_FINDIFF, ACCEL_POLY, CATEGORY_POLY, GROWTH_FINDIFF, GROWTH_POLY, RELATIVE
from tidepanel.catalog.scalars import present_ctes
from tidepanel.catalog.views import Query, bank
from tidepanel.functions.derived import present_formulas
from tidepanel.plans.dataset import DatasetSpec, load_dataset

# Trends are asked for these; all other columns are on the avoid list.
TRENDS = ("mv_msaldototal", "z_sueldototal", "tcajas")
FIELDS = {
    "__MAX": "hi", "__MIN": "lo", "__CREC_POLI": "growth_poly", "__CREC_DIFINI": "growth_findiff", "__ACEL_POLI": "accel_poly",
    "__ACEL_DIFINI": "accel_findiff", "__ACEL_POLI__CAT_POLI": "category", "__ANDREU": "relative",
}


def load_dataset_(spark, sf):
    """All months of the table; two columns are without any value."""
    rows = bank(spark, sf).withColumns({c: F.lit(None).cast("double") for c in ("Master_marca_atraso", "tcajas_otras")})
    avoid = tuple(c for c in [*rows.columns, *[f.name for f in present_formulas()]] if c not in TRENDS)
    spec = DatasetSpec(
        key="k", period="p", unused=("unused",), no_trend=avoid, salary="tplan_sueldo", derived=True, max_min=True, drop_last=("tcajas_otras",)
    )
    made = load_dataset(rows.withColumn("unused", F.lit(1)), None, spec)
    return made.select(
        "k", "p", F.col("cliente_edad").alias("age_bin"), "z_prom_prestamos", "vivi_antig_ratio", F.col("dependencia_salarial").alias("flag"),
        *[F.col(f"{c}{suffix}").alias(f"{c}_{name}") for c in TRENDS for suffix, name in FIELDS.items()],
    )


def _lag_cte(c: str) -> str:
    return f"""lags_{c} AS (SELECT t.k, t.p, coalesce(l3.{c}, 0) AS y0, coalesce(l2.{c}, 0) AS y1, coalesce(l1.{c}, 0) AS y2, coalesce(t.{c}, 0) AS y3
  FROM d t LEFT JOIN d l1 ON l1.k = t.k AND l1.mi = t.mi - 1 LEFT JOIN d l2 ON l2.k = t.k AND l2.mi = t.mi - 2
  LEFT JOIN d l3 ON l3.k = t.k AND l3.mi = t.mi - 3)"""


def _trend_ctes(c: str) -> str:
    return f"""spans_{c} AS (SELECT *, greatest(y0, y1, y2, y3) AS hi, least(y0, y1, y2, y3) AS lo FROM lags_{c}),
trends_{c} AS (SELECT k, p, hi AS {c}_hi, lo AS {c}_lo, {GROWTH_POLY} AS {c}_growth_poly, {GROWTH_FINDIFF} AS {c}_growth_findiff,
  {ACCEL_POLY} AS {c}_accel_poly, {ACCEL_FINDIFF} AS {c}_accel_findiff, {CATEGORY_POLY} AS {c}_category, {RELATIVE} AS {c}_relative
  FROM spans_{c})"""


def _dataset_sql() -> str:
    replaced = "SELECT * REPLACE (NULL::DOUBLE AS Master_marca_atraso, NULL::DOUBLE AS tcajas_otras) FROM bank"
    views = [present_ctes(replaced), "d AS (SELECT *, (p // 100) * 12 + p % 100 AS mi FROM present)"]
    views += [_lag_cte("tplan_sueldo")] + [_lag_cte(c) + ",\n" + _trend_ctes(c) for c in TRENDS]
    outputs = ", ".join(f"{c}_{name}" for c in TRENDS for name in FIELDS.values())
    joins = " ".join(f"JOIN trends_{c} USING (k, p)" for c in TRENDS)
    return ",\n".join(views) + f"""
SELECT d.k, d.p, CASE WHEN cliente_edad IS NULL THEN NULL WHEN cliente_edad <= 18 THEN '(-Inf,18]' WHEN cliente_edad <= 25 THEN '(18,25]'
         WHEN cliente_edad <= 40 THEN '(25,40]' WHEN cliente_edad <= 55 THEN '(40,55]' ELSE '(55, Inf]' END AS age_bin,
       z_prom_prestamos, vivi_antig_ratio, CAST(CASE WHEN s.y0 + s.y1 + s.y2 + s.y3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS flag, {outputs}
FROM d {joins} JOIN lags_tplan_sueldo s USING (k, p)"""


QUERIES = {"load_dataset": Query(load_dataset_, _dataset_sql())}
