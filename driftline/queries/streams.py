"""Streams over the events table, drained to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.queries.common import table
from driftline.streaming import changes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select("event_id", "user_id", "event_type", "value", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))").alias("at"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour by kind of event."""
    out = changes.windowed(_events(spark, sf_dir), "at", "1 day", "1 hour", None, ["event_type"], "value")
    rows = changes.drained(out, "w" + uuid.uuid4().hex[:8])
    return rows.select("event_type", F.unix_seconds("start").alias("start_s"), "n", F.rint(F.col("total") * 100).cast("long").alias("total_cent"), "peak")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changes.windowed(_events(spark, sf_dir), "at", "1 day", "2 hours", "1 hour", [], "value")
    rows = changes.drained(out, "s" + uuid.uuid4().hex[:8])
    return rows.select(F.unix_seconds("start").alias("start_s"), "n", F.rint(F.col("total") * 100).cast("long").alias("total_cent"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changes.sessions(_events(spark, sf_dir), "at", "1 day", "30 minutes", ["user_id"])
    rows = changes.drained(out, "x" + uuid.uuid4().hex[:8])
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


QUERIES = {f.__name__: f for f in (stream_windows, stream_sliding, stream_sessions)}

ORACLE_SQL = {
    "stream_windows": "SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS start_s, count(*) AS n, CAST(round_even(sum(value) * 100, 0) AS BIGINT) AS total_cent, max(value) AS peak FROM events GROUP BY ALL",
    "stream_sliding": """WITH v AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS s, value FROM events), w AS (SELECT s AS start_s, value FROM v UNION ALL SELECT s - 3600, value FROM v)
    SELECT start_s, count(*) AS n, CAST(round_even(sum(value) * 100, 0) AS BIGINT) AS total_cent FROM w GROUP BY start_s""",
    "stream_sessions": """WITH v AS (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    i AS (SELECT *, sum(CASE WHEN p IS NULL OR u >= p + 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS g FROM v)
    SELECT user_id, min(u) AS start_us, max(u) + 1800000000 AS end_us, count(*) AS n FROM i GROUP BY user_id, g""",
}
