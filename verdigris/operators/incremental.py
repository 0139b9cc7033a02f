"""Metrics that grow by input partition: counts that add up are stored per partition and merged on demand.

A state is a table of counts by group, label, call and bin of probability, one folder a partition. Confusion rates,
calibration tables and threshold sweeps are functions of the sum of such states, so a new partition costs only
itself, and one that is added again is not counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from . import calibration, metrics

STATE = "label int, pred int, bin int, above int, n long, sum_v decimal(38,18)"


class Metrics:
    """Stored states of a stream of prediction partitions."""

    def __init__(self, spark: SparkSession, path: str, by: dict[str, str] | None = None, bounds: list[float] | None = None, steps: int = 100, prob: str = "Prob", label: str = "Label", pred: str = "Prediction"):
        """by: names and types of grouping columns; bounds: edges of the calibration's bins; steps of the threshold sweep."""
        self.spark, self.path, self.by, self.steps = spark, path.rstrip("/"), by or {}, steps
        self.bounds = bounds or calibration.edges("0.5", "1", "0.05")
        self.prob, self.label, self.pred = prob, label, pred

    @property
    def schema(self) -> str:
        return ", ".join([*(f"`{k}` {t}" for k, t in self.by.items()), STATE])

    def state(self, df: DataFrame) -> DataFrame:
        """The counts of one partition: a row for each group, label, call, bin and threshold met, whatever the number of rows."""
        v = calibration.confidence(self.prob)
        bin_, above = calibration.bin_of(v, self.bounds), calibration.threshold_step(F.col(self.prob), self.steps)
        keys = [F.col(self.label).cast("int").alias("label"), F.col(self.pred).cast("int").alias("pred"), bin_.cast("int").alias("bin"), above.alias("above")]
        return df.groupBy(*self.by, *keys).agg(F.count("*").alias("n"), F.sum(v.cast("decimal(28,18)")).cast("decimal(38,18)").alias("sum_v"))

    def add(self, partition: str, df: DataFrame) -> bool:
        """Stores the partition's state unless it is there whole; whether it was new."""
        folder = f"{self.path}/part={partition}"
        if sinks.exists(self.spark, f"{folder}/_SUCCESS"):
            return False
        self.state(df).coalesce(1).write.mode("overwrite").parquet(folder)  # few rows
        return True

    def merged(self) -> DataFrame:
        """The sum of all stored states."""
        keys = [*self.by, "label", "pred", "bin", "above"]
        if not sinks.exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sum_v").cast("decimal(38,18)").alias("sum_v"))

    @staticmethod
    def _n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    def confusion(self, by: list[str] | None = None) -> DataFrame:
        """A-1, A-6: as metrics.confusion over all rows added so far."""
        y, p = F.col("label"), F.col("pred")
        cells = {"tp": (y == 1) & (p == 1), "tn": (y == 0) & (p == 0), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "total": y.isin(0, 1) & p.isin(0, 1)}
        return self.merged().groupBy(*(by or [])).agg(*[self._n(c).alias(k) for k, c in cells.items()]).select("*", *metrics.rates())

    def calibration(self) -> DataFrame:
        """A-11: as calibration.calibration over all rows added so far."""
        n = F.sum("n")
        hits = self._n(F.col("label") == F.col("pred"))
        rate = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
        both = F.sum(F.when(F.col("label").isNotNull() & F.col("pred").isNotNull(), F.col("n")))
        rows = self.merged().where("bin is not null").groupBy("bin").agg(n.alias("count"), (hits / both).alias("acc_"), (F.sum("sum_v").cast("double") / n).alias("avg_"), rate("label").alias("lab_"), rate("pred").alias("pred_"))
        return calibration.calibration_table(rows)

    def sweep(self) -> DataFrame:
        """A-15: as calibration.sweep over all rows added so far."""
        hist = self.merged().groupBy(F.col("above").alias("b")).agg(self._n(F.col("label") == 1).alias("p"), self._n(F.col("label") == 0).alias("n"))
        return calibration.swept(hist, self.steps)
