"""Outputs of a job's phases, kept so that a job that stopped goes on after its last whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Phases:
    """Tables of phases under a folder that driver and executors share. A phase is complete once its write has ended (Spark's _SUCCESS);
    of a known order, every phase before the latest complete one counts as complete too."""

    def __init__(self, spark: SparkSession, folder: str, order: list[str] | None = None):
        self.spark, self.folder, self.order = spark, folder.rstrip("/"), order

    def _path(self, phase: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{phase}")

    def _written(self, phase: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(phase), "_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def save(self, phase: str, rows: DataFrame) -> DataFrame:
        """Writes a phase's rows and reads them back: later phases start from the table."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{phase}")
        return self.load(phase)

    def load(self, phase: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{phase}")

    def complete(self, phase: str) -> bool:
        if self.order and phase in self.order:
            return any(self._written(p) for p in self.order[self.order.index(phase) :])
        return self._written(phase)

    def run(self, phase: str, make) -> DataFrame:
        """The phase's rows: as they were written, or made now."""
        return self.load(phase) if self._written(phase) else self.save(phase, make())

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
