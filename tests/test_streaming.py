"""Stateful ingest: versions out of order, unchanged ones and late ones."""

import datetime

from citeloom.sources.store import Store
from citeloom.streaming.ingest import ingest_changed

SCHEMA = "id string, document_id string, version long, fingerprint string, at timestamp, text string"


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_only_newer_versions_that_differ_are_taken(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    empty = spark.createDataFrame([], SCHEMA)
    store.create("docs", empty)

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = ingest_changed(spark, str(tmp_path / "in"), empty.schema, store, "docs", str(tmp_path / "ck"), "2 days")
        query.awaitTermination()
        return {r.id: (r.version, r.text) for r in store.read("docs").collect()}

    # a newer version before an older one, and two at once of which the newest counts
    assert arrive(("a", "a", 2, "f2", at(10), "two"), ("b", "b", 1, "g1", at(10), "one"), ("b", "b", 3, "g3", at(10), "three"), (None, None, 1, "x", at(10), "none")) == {"a": (2, "two"), "b": (3, "three")}
    got = arrive(("a", "a", 1, "f1", at(10), "one"), ("b", "b", 2, "g2", at(10), "two"), ("c", "c", 1, "h1", at(20), "one"))
    assert got == {"a": (2, "two"), "b": (3, "three"), "c": (1, "one")}
    # the same fingerprint is no change, but the version counts from then on; what is behind the watermark (day 18) is dropped
    got = arrive(("a", "a", 5, "f2", at(20), "five, unchanged"), ("d", "d", 1, "k1", at(3), "too late"))
    assert got == {"a": (2, "two"), "b": (3, "three"), "c": (1, "one")}
    got = arrive(("a", "a", 4, "f4", at(20), "four, overtaken"), ("a", "a", 6, "f6", at(21), "six"), ("c", "c", 2, "h2", at(19), "in time"))
    assert got == {"a": (6, "six"), "b": (3, "three"), "c": (2, "in time")}
