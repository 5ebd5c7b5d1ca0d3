"""Queries against their SQL on numbers that lie half-way between two rounded ones."""

from datetime import datetime, timedelta

from tests.oracle import difference

from driftline.queries import ORACLE_SQL, QUERIES


def test_confidence_blend(spark, tmp_path):
    """Pairs of lines in groups of their own, for every pair of quantities."""
    rows = [(f"{d}-{a}-{b}", 2, d / 100, d / 100, float(q)) for d in (0, 1, 3, 8) for a in range(1, 51) for b in range(1, a) for q in (a, b)]
    spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_discount double, l_tax double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert difference(spark, str(tmp_path), QUERIES["confidence_blend"], ORACLE_SQL["confidence_blend"]) == ""


def test_first_record_latency(spark, tmp_path):
    """First records half a millisecond off."""
    rows = [(k, k, datetime(2024, 1, 1) + timedelta(days=k % 30, milliseconds=k * 37, microseconds=500)) for k in range(1000)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert difference(spark, str(tmp_path), QUERIES["first_record_latency"], ORACLE_SQL["first_record_latency"]) == ""
