"""Association-test trees on supplier months, two levels of which SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.boosting import EXACT
from tidepanel.catalog.views import LABELLED, Query, labelled, with_
from tidepanel.operators import association

FEATURES = ("n", "v", "a", "r")
PARTS = 8
ALPHA, MIN_SPLIT, MIN_LEAF = 0.05, 20, 7


def _tree(rows):
    return association.association_tree(rows, FEATURES, "clase", 2, PARTS, ALPHA, MIN_SPLIT, MIN_LEAF, EXACT)


def association_tree_(spark, sf):
    """Nodes of the tree on the ternary class: the feature and bin each splits at, its statistic and corrected p value."""
    nodes = _tree(labelled(spark, sf)).table(spark)
    return nodes.withColumns({"statistic": F.round("statistic", 4), "log_p": F.round("log_p", 4)})


def association_classify_(spark, sf):
    """Actual against predicted class."""
    rows = labelled(spark, sf)
    return _tree(rows).classify(rows, "clase").groupBy(F.col("clase").alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n"))


def _level(level: int) -> list[str]:
    """Tests and splits of the nodes of table at<level>, and the table of the level below."""
    return [
        f"cells{level} AS (SELECT node, f, bin, clase, count(*) AS n FROM at{level} JOIN bins USING (k, p) WHERE bin > 0 GROUP BY ALL)",
        f"""margins{level} AS (
  SELECT *, sum(n) OVER (PARTITION BY node, f) AS total, sum(n) OVER (PARTITION BY node, f, bin) AS by_bin, sum(n) OVER (PARTITION BY node, f, clase) AS by_class
  FROM cells{level})""",
        f"""tests{level} AS (
  SELECT node, f, any_value(total) * (sum(CAST(n AS DOUBLE) * n / (CAST(by_bin AS DOUBLE) * by_class)) - 1) AS x,
         (count(DISTINCT bin) - 1) * (count(DISTINCT clase) - 1) // 2 AS half
  FROM margins{level} GROUP BY ALL HAVING count(DISTINCT bin) > 1 AND count(DISTINCT clase) > 1)""",
        # Three classes: the degrees of freedom are even and the tail is a short sum.
        f"""tails{level} AS (
  SELECT node, f, any_value(x) AS x, least(0, ln(sum(power(x / 2, i) / factorial(CAST(i AS INTEGER)))) - any_value(x) / 2 + ln(any_value(m))) AS log_p
  FROM (SELECT *, count(*) OVER (PARTITION BY node) AS m, unnest(range(0, half)) AS i FROM tests{level}) GROUP BY ALL)""",
        f"""chosen{level} AS (
  SELECT t.* EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY log_p, f) AS place FROM tails{level}) AS t
  JOIN (SELECT node FROM at{level} GROUP BY node HAVING count(*) >= {MIN_SPLIT}) USING (node) WHERE place = 1 AND log_p <= ln({ALPHA}::DOUBLE))""",
        f"""sides{level} AS (
  SELECT c.node, c.f, t.bin AS t, c.clase, c.bin >= t.bin AS right_, sum(c.n) AS n
  FROM cells{level} AS c JOIN chosen{level} USING (node, f) JOIN (SELECT DISTINCT node, f, bin FROM cells{level}) AS t ON t.node = c.node AND t.f = c.f GROUP BY ALL)""",
        f"""halves{level} AS (
  SELECT *, sum(n) OVER (PARTITION BY node, t) AS total, sum(n) OVER (PARTITION BY node, t, right_) AS by_side, sum(n) OVER (PARTITION BY node, t, clase) AS by_class
  FROM sides{level})""",
        f"""split{level} AS (
  SELECT * EXCLUDE (x, place) FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY x DESC, t) AS place FROM (
      SELECT node, f, t, any_value(total) * (sum(CAST(n AS DOUBLE) * n / (CAST(by_side AS DOUBLE) * by_class)) - 1) AS x,
             sum(n) FILTER (WHERE right_) > sum(n) FILTER (WHERE NOT right_) AS missing_right
      FROM halves{level} GROUP BY ALL HAVING count(DISTINCT right_) = 2 AND min(by_side) >= {MIN_LEAF})) WHERE place = 1)""",
        f"""at{level + 1} AS (
  SELECT a.k, a.p, clase, 2 * a.node + 1 + CASE WHEN bin = 0 THEN CAST(missing_right AS INTEGER) WHEN bin >= t THEN 1 ELSE 0 END AS node
  FROM at{level} AS a JOIN split{level} AS s ON s.node = a.node JOIN bins AS b ON b.k = a.k AND b.p = a.p AND b.f = s.f)""",
    ]


_GROWN = with_(
    LABELLED,
    "long AS (" + " UNION ALL ".join(f"SELECT k, p, {i} AS f, CAST({c} AS DOUBLE) AS x FROM labelled" for i, c in enumerate(FEATURES)) + ")",
    """ranked AS (
  SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS i, count(*) OVER (PARTITION BY f) AS n, min(x) OVER (PARTITION BY f) AS low
  FROM long WHERE x IS NOT NULL)""",
    f"borders AS (SELECT DISTINCT f, x AS b FROM ranked, range(1, {PARTS}) AS parts(part) WHERE i = (part * n + {PARTS - 1}) // {PARTS} AND x > low)",
    """bins AS (
  SELECT k, p, l.f, CASE WHEN any_value(x) IS NULL THEN 0 ELSE 1 + count(b) END AS bin
  FROM long AS l LEFT JOIN borders AS s ON s.f = l.f AND s.b <= l.x GROUP BY k, p, l.f)""",
    "at0 AS (SELECT k, p, clase, 0 AS node FROM labelled)",
    *_level(0), *_level(1),
    "members AS (SELECT node, clase FROM at0 UNION ALL SELECT node, clase FROM at1 UNION ALL SELECT node, clase FROM at2)",
    """frequent AS (
  SELECT node, sum(n) AS n, first(clase ORDER BY n DESC, clase) AS predicted FROM (SELECT node, clase, count(*) AS n FROM members GROUP BY ALL) GROUP BY node)""",
    "splits AS (SELECT s.node, s.f, s.t, x, log_p FROM split0 AS s JOIN chosen0 USING (node) UNION ALL SELECT s.node, s.f, s.t, x, log_p FROM split1 AS s JOIN chosen1 USING (node))",
)

QUERIES = {
    "association_tree": Query(
        association_tree_,
        _GROWN + "SELECT CAST(node AS INTEGER) AS node, CAST(n AS BIGINT) AS n, CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES))
        + " END AS feature, CAST(t AS INTEGER) AS threshold, round(x, 4) AS statistic, round(log_p, 4) AS log_p, predicted FROM frequent LEFT JOIN splits USING (node)",
    ),
    "association_classify": Query(
        association_classify_,
        _GROWN + """, leaves AS (
  SELECT * FROM at2 UNION ALL SELECT * FROM at1 WHERE node NOT IN (SELECT node FROM split1) UNION ALL SELECT * FROM at0 WHERE node NOT IN (SELECT node FROM split0))
SELECT l.clase AS actual, predicted, count(*) AS n FROM leaves AS l JOIN frequent USING (node) GROUP BY ALL""",
    ),
}
