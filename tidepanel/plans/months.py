"""Panel features kept on disk and extended month by month.

A new month needs its own rows and those of the three months before it, so only
these are read, however long the history is. Each step overwrites whole months:
a run that broke off is simply run again, and a month that is delivered a second
time replaces the first one. A month without any row is not a delivery and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.functions.periods import backward_month_list, periods_needed
from tidepanel.operators.panel import BACKWARD, PanelSpec, panel_features


@dataclass(frozen=True)
class MonthStore:
    """Snapshot rows of ``schema`` and their features, a folder per month each, below ``path``."""

    spark: SparkSession
    path: str
    spec: PanelSpec
    schema: StructType

    def _write(self, df: DataFrame, name: str) -> None:
        # One job for all months; a month with most rows is written by several tasks.
        (
            df.hint("rebalance", self.spec.period)
            .write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(self.spec.period).parquet(f"{self.path}/{name}")
        )

    def rows(self, periods: Sequence[int] | None = None) -> DataFrame:
        """Kept rows; the folders of other months are not read."""
        df = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return df if periods is None else df.where(F.col(self.spec.period).isin(list(periods)))

    def features(self, periods: Sequence[int] | None = None) -> DataFrame:
        df = self.spark.read.option("mergeSchema", "false").parquet(f"{self.path}/features")
        return df if periods is None else df.where(F.col(self.spec.period).isin(list(periods)))

    def append(self, rows: DataFrame, periods: Sequence[int]) -> None:
        """Keep the rows of ``periods`` and make their features, from them and the three months before each.

        Months come in order: the features of later months that are already there
        do not change. :meth:`restate` is for a month that was delivered again.
        """
        wanted = list(periods)
        self._write(rows.where(F.col(self.spec.period).isin(wanted)).select(self.schema.fieldNames()), "rows")
        self.refresh(wanted)

    def refresh(self, periods: Sequence[int]) -> None:
        """Make the features of kept months anew."""
        wanted = list(periods)
        self._write(panel_features(self.rows(periods_needed(wanted, BACKWARD)), self.spec, wanted), "features")

    def restate(self, rows: DataFrame, period: int) -> None:
        """Replace the rows of a month, and the features of it and of the three months that look back on it."""
        self._write(rows.where(F.col(self.spec.period) == period).select(self.schema.fieldNames()), "rows")
        year, month = divmod(period // 100 * 12 + period % 100 - 1 + BACKWARD, 12)
        self.refresh(backward_month_list(year * 100 + month + 1, BACKWARD))
