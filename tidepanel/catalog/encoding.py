"""Rows and columns made for the learner: category columns in terms of the label, new rows of a rare class."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.views import LABELLED, Query, labelled, table, with_
from tidepanel.operators import encode, synthetic


def _sides(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.where(F.col("quality").isNotNull()), rows.where(F.col("quality").isNull())


def target_statistics_(spark, sf):
    """Share of good documents of the same source, among those before a labelled one and among all labelled ones for the rest."""
    train, new = _sides(spark, sf)
    earlier = encode.ordered_target_statistics(train, "source", "quality", "doc_id")
    later = encode.with_target_statistics(new, encode.target_totals(train, "source", "quality"), "source")
    return earlier.select("doc_id", F.lit("train").alias("side"), "source__ts").unionByName(later.select("doc_id", F.lit("new").alias("side"), "source__ts"))


RARE_FEATURES = ("n", "v", "m")


def smoothed_bootstrap_(spark, sf):
    """Supplier months, with three new ones for each that is followed by a late drop."""
    rows = labelled(spark, sf).withColumn("id", F.concat_ws("-", F.col("k").cast("string"), F.col("p").cast("string")))
    made = synthetic.smoothed_bootstrap(rows.select("id", "clase", *RARE_FEATURES), "clase", "BAJA+2", "id", RARE_FEATURES, times=3)
    return made.select("id", "clase", "draw", *[F.round(c, 4).alias(c) for c in RARE_FEATURES])


def _normal_sql(i: int) -> str:
    u = lambda end: f"(CAST(CAST('0x' || substr(md5(concat(text, '-{i}-{end}')), 1, 15) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 1152921504606846976::DOUBLE"
    return f"sqrt(-2 * ln({u('a')})) * cos(2 * pi() * {u('b')})"


QUERIES = {
    "smoothed_bootstrap": Query(
        smoothed_bootstrap_,
        with_(LABELLED).rstrip() + """,
rows AS (SELECT concat(CAST(k AS VARCHAR), '-', CAST(p AS VARCHAR)) AS id, clase, CAST(n AS DOUBLE) AS n, v, m FROM labelled),
rare AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM rows WHERE clase = 'BAJA+2'),
spread AS (SELECT count(*) AS size, power(4.0::DOUBLE / (5 * count(*)), 1.0::DOUBLE / 7) AS factor, """
        + ", ".join(f"stddev_samp({c}) AS sd{i}" for i, c in enumerate(RARE_FEATURES)) + """ FROM rare),
draws AS (SELECT concat(id, '-', CAST(i AS VARCHAR), '-1') AS text, i AS draw FROM rare, range(1, 4) AS times(i)),
placed AS (SELECT text, draw, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) % (SELECT size FROM spread) + 1 AS place FROM draws)
SELECT id, clase, 0 AS draw, """ + ", ".join(f"round({c}, 4) AS {c}" for c in RARE_FEATURES) + """ FROM rows
UNION ALL SELECT id, clase, CAST(draw AS INTEGER), """
        + ", ".join(f"round({c} + factor * sd{i} * {_normal_sql(i)}, 4)" for i, c in enumerate(RARE_FEATURES)) + " FROM placed JOIN rare USING (place), spread",
    ),
    "target_statistics": Query(
        target_statistics_,
        """WITH rows AS (SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)),
train AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-1')), doc_id) AS i FROM rows WHERE quality IS NOT NULL),
sums AS (
  SELECT doc_id, coalesce(sum(quality) OVER w, 0) AS hits, i - 1 AS n FROM train
  WINDOW w AS (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
totals AS (SELECT source, sum(quality) AS hits, count(*) AS n FROM train GROUP BY source)
SELECT doc_id, 'train' AS side, (CAST(hits AS DOUBLE) + 0.5::DOUBLE) / (n + 1::DOUBLE) AS source__ts FROM sums
UNION ALL
SELECT doc_id, 'new', (CAST(coalesce(hits, 0) AS DOUBLE) + 0.5::DOUBLE) / (coalesce(n, 0) + 1::DOUBLE)
FROM rows AS r LEFT JOIN totals AS t ON r.source IS NOT DISTINCT FROM t.source WHERE quality IS NULL""",
    ),
}
