"""Overlaps across a multiple of 100,000 hours."""

from datetime import datetime, timezone

from citeloom.plans.queries import QUERIES


def test_overlap_across_a_multiple_of_100000_hours(spark, tmp_path):
    at = lambda hour: datetime.fromtimestamp(hour * 3600, timezone.utc)
    rows = [(1, 4, at(499998)), (1, 5, at(500000)), (1, 7, at(500001)), (2, 9, at(500000))]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["range_overlap_join"](spark, str(tmp_path)).select("user_id", "left_id", "right_id").collect()}
    assert got == {(1, 4, 5), (1, 4, 7)}
