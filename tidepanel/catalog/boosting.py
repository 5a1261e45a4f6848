"""Symmetric trees on supplier months, small enough that SQL can follow each sum."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.views import LABELLED, Query, labelled, with_
from tidepanel.functions.columns import target_train
from tidepanel.operators import boost
from tidepanel.operators.boost import BoostParams, Forest, Model
from tidepanel.plans import boosting

FEATURES = ("n", "v", "a", "r")
# Borders at sixteenths, ranks that every engine finds exactly.
PARAMS = BoostParams(iterations=2, depth=2, border_count=15, learning_rate=0.3, l2_leaf_reg=3.0, random_strength=0.0, bagging_temperature=1.0, seed=7)
# Sketches of this accuracy return exact ranks up to so many rows.
EXACT = 2_000_000


def _rows(spark, sf):
    return labelled(spark, sf).withColumn("target", target_train(F.col("clase")))


def _forest(rows) -> Forest:
    binning = boost.learn_bins(rows, FEATURES, PARAMS.border_count, EXACT)
    return boost.train_models(boost.train_rows(binning, rows, "target", boosting.row_id(["k", "p"])), binning, [Model(PARAMS)])


def boost_train_(spark, sf):
    """Probability of leaving after two trees of depth two, with row weights and regularised leaves."""
    rows = _rows(spark, sf)
    return _forest(rows).score(rows, "k", "p").withColumn("prob", F.round("prob", 6))


def boost_staged_(spark, sf):
    """Profit and log-loss after one and after two trees, from one training."""
    rows = _rows(spark, sf)
    found = boosting.staged_metrics(_forest(rows), rows, "target")
    return found.withColumn("logloss", F.round("logloss", 6))


def _weight(tree: int) -> str:
    """The weight of a row in a tree, from the number that stands for the row."""
    prime, seed = boost.PRIME, PARAMS.seed
    return f"""w{tree} AS (
  SELECT k, p, -ln(((z * z + y) % {prime} + 0.5::DOUBLE) / {prime}::DOUBLE) AS w FROM (
    SELECT *, (y * y + 16807 * {tree} + id) % {prime} AS z FROM (
      SELECT *, (x * x + 48271 * id + {seed}) % {prime} AS y FROM (
        SELECT k, p, id, (id + 7919 * {seed} + 104729 * {tree} + 1) % {prime} AS x FROM base))))"""


def _tree(tree: int) -> list[str]:
    """One tree: gradients from the scores of the table raw<tree>, a split per level, and the table of scores after it."""
    unit, l2 = f"{boost.UNIT:.0f}", f"{PARAMS.l2_leaf_reg}::DOUBLE"
    half = lambda s: f"({s}g / {unit}::DOUBLE) * ({s}g / {unit}::DOUBLE) / ({s}h / {unit}::DOUBLE + {l2})"
    made = [
        _weight(tree),
        f"""p{tree} AS (SELECT k, p, y, raw, w, 1 / (1 + exp(-raw)) AS q FROM raw{tree} JOIN w{tree} USING (k, p))""",
        f"""leaf{tree}_0 AS (
  SELECT k, p, 0 AS leaf, CAST(floor((y - q) * w * {unit} + 0.5) AS BIGINT) AS g, CAST(floor(q * (1 - q) * w * {unit} + 0.5) AS BIGINT) AS h FROM p{tree})""",
    ]
    for level in range(PARAMS.depth):
        now = f"{tree}_{level}"
        made += [
            f"""sums{now} AS (
  SELECT leaf, f, t, CAST(coalesce(sum(g) FILTER (WHERE bin < t), 0) AS DOUBLE) AS lg, CAST(coalesce(sum(h) FILTER (WHERE bin < t), 0) AS DOUBLE) AS lh,
         CAST(coalesce(sum(g) FILTER (WHERE bin >= t), 0) AS DOUBLE) AS rg, CAST(coalesce(sum(h) FILTER (WHERE bin >= t), 0) AS DOUBLE) AS rh
  FROM leaf{now} JOIN bins USING (k, p) JOIN splits USING (f) GROUP BY ALL)""",
            f"""best{now} AS (
  SELECT f, t FROM (SELECT f, t, sum({half('l')} + {half('r')}) AS score FROM sums{now} GROUP BY ALL) ORDER BY score DESC, f, t LIMIT 1)""",
            f"""leaf{tree}_{level + 1} AS (
  SELECT k, p, leaf + CASE WHEN bin >= t THEN {1 << level} ELSE 0 END AS leaf, g, h FROM leaf{now} JOIN bins USING (k, p) JOIN best{now} USING (f))""",
        ]
    last = f"leaf{tree}_{PARAMS.depth}"
    made += [
        f"value{tree} AS (SELECT leaf, CAST(sum(g) AS DOUBLE) / {unit}::DOUBLE AS vg, CAST(sum(h) AS DOUBLE) / {unit}::DOUBLE AS vh FROM {last} GROUP BY leaf)",
        f"""raw{tree + 1} AS (
  SELECT k, p, y, raw + {PARAMS.learning_rate}::DOUBLE * (vg / ({l2} + vh)) AS raw FROM raw{tree} JOIN {last} USING (k, p) JOIN value{tree} USING (leaf))""",
    ]
    return made


_PARTS = PARAMS.border_count + 1
_TREES = with_(
    LABELLED,
    """base AS (
  SELECT *, CASE WHEN clase = 'CONTINUA' THEN 0 ELSE 1 END AS y,
         CAST('0x' || substr(md5(concat(CAST(k AS VARCHAR), '-', CAST(p AS VARCHAR))), 1, 7) AS BIGINT) AS id FROM labelled)""",
    "long AS (" + " UNION ALL ".join(f"SELECT k, p, {i} AS f, CAST({c} AS DOUBLE) AS x FROM base" for i, c in enumerate(FEATURES)) + ")",
    """ranked AS (
  SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS i, count(*) OVER (PARTITION BY f) AS n, min(x) OVER (PARTITION BY f) AS low
  FROM long WHERE x IS NOT NULL)""",
    f"borders AS (SELECT DISTINCT f, x AS b FROM ranked, range(1, {_PARTS}) AS parts(part) WHERE i = (part * n + {_PARTS - 1}) // {_PARTS} AND x > low)",
    """bins AS (
  SELECT k, p, l.f, CASE WHEN any_value(x) IS NULL THEN 0 ELSE 1 + count(b) END AS bin
  FROM long AS l LEFT JOIN borders AS s ON s.f = l.f AND s.b <= l.x GROUP BY k, p, l.f)""",
    f"""splits AS (
  SELECT f, unnest(range(1, 2 + n)) AS t FROM (SELECT f, count(b) AS n FROM range(0, {len(FEATURES)}) AS all_(f) LEFT JOIN borders USING (f) GROUP BY f))""",
    "raw0 AS (SELECT k, p, y, 0::DOUBLE AS raw FROM base)",
    *[cte for tree in range(PARAMS.iterations) for cte in _tree(tree)],
)

QUERIES = {
    "boost_train": Query(boost_train_, _TREES + f"SELECT k, p, round(1 / (1 + exp(-raw)), 6) AS prob FROM raw{PARAMS.iterations}"),
    "boost_staged": Query(
        boost_staged_,
        _TREES.rstrip() + """,
steps AS (SELECT 1 AS trees, y, 1 / (1 + exp(-raw)) AS prob FROM raw1 UNION ALL SELECT 2, y, 1 / (1 + exp(-raw)) FROM raw2),
sweep AS (
  SELECT trees, k, sum(CASE WHEN prob > k / 1000.0::DOUBLE THEN CASE WHEN y = 1 THEN 11700 ELSE -300 END ELSE 0 END) AS profit
  FROM steps, range(0, 101) AS cutoffs(k) GROUP BY ALL),
losses AS (SELECT trees, round(avg(-(CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END)), 6) AS logloss FROM steps GROUP BY trees),
top AS (SELECT trees, max(profit) AS profit, max(CASE WHEN k = 25 THEN profit END) AS profit_0025 FROM sweep GROUP BY trees)
SELECT CAST(trees AS INTEGER) AS trees, CAST(t.profit AS BIGINT) AS profit, max(k) / 1000.0::DOUBLE AS cutoff, CAST(any_value(t.profit_0025) AS BIGINT) AS profit_0025,
       any_value(logloss) AS logloss
FROM top AS t JOIN sweep AS s USING (trees) JOIN losses USING (trees) WHERE s.profit = t.profit GROUP BY ALL""",
    ),
}
