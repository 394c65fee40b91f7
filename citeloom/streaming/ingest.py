"""Incremental ingest of spans: new files are merged into a store as they come (an extension; batch operators don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.store import Store


def ingest(spark: SparkSession, source: str, schema: StructType, store: Store, table: str, checkpoint: str, order: str | None = None):
    """Starts a query that upserts each batch of new files; returns it."""

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(table, batch, order)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once, as long as repeats come within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


class _Newest(StatefulProcessor):
    """For each document the version last passed on and its fingerprint; only newer versions of another fingerprint pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, fingerprint string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = self.last.get() if self.last.exists() else None
        version, fingerprint = held if held is not None else (None, None)
        passed = []
        for some in rows:
            for row in some.sort_values("version", kind="stable").itertuples(index=False):
                if version is None or row.version > version:
                    if row.fingerprint != fingerprint:
                        passed.append(row)
                    version, fingerprint = int(row.version), row.fingerprint
        if version is not None and (version, fingerprint) != held:
            self.last.update((version, fingerprint))
        # of the versions of one batch the newest stands for all
        if passed:
            yield pd.DataFrame(passed[-1:])

    def close(self) -> None:
        pass


def changed(versions: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of versions(document_id, version, fingerprint, at, ..) without those that change nothing: what isn't newer than the version last seen of its document, or has its fingerprint, goes, and so does what is older than the watermark.

    State is one version and fingerprint a document, keyed and partitioned by it. Of several new versions in one batch
    the newest passes. Rows without a document, version or time are left out.
    """
    sound = versions.where("document_id IS NOT NULL AND version IS NOT NULL AND at IS NOT NULL")
    rows = sound.withWatermark("at", delay).groupBy("document_id")
    return rows.transformWithStateInPandas(_Newest(), versions.schema, "Append", "EventTime")


def ingest_changed(spark: SparkSession, source: str, schema: StructType, store: Store, table: str, checkpoint: str, delay: str = "1 day"):
    """Starts a query that upserts what changed() lets through of new files, oldest first; returns it. schema: id, document_id, version, fingerprint, at and the table's other columns."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1000").parquet(source)

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(table, batch, "version")

    # the state of this operator needs a store that keeps several columns; a query holds the one it was started with
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return changed(rows, delay).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)
