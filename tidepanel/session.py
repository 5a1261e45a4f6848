"""Session defaults and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# HotSpot never compiles methods above this size, so a fused stage beyond it would run
# interpreted; Spark then uses its smaller per-operator methods instead.
_HOTSPOT_METHOD_LIMIT = "8000"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for wide feature tables; values already changed by the caller stay."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", _HOTSPOT_METHOD_LIMIT)
    return spark


def build_session(app: str = "tidepanel", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where they are given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Checkpoints of finished queries are removed with the DataFrames that held them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tidepanel-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tidepanel-scratch/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Marks a narrow, written ``df`` for broadcast if it has at most ``rows`` rows; else the join stays a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later uses read the same rows.

    Needed where a row carries something that a second run could decide
    differently, such as the id of its range partition.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
