"""Streams of changes and telemetry: incremental counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from driftline.plans.scratch import Scratch
from driftline.sources.records import CHANGE


def change_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Change records as files arrive in a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_a_trigger).json(folder).filter("x0 IS NOT NULL AND x1 IS NOT NULL")


def running_counts(changes: DataFrame) -> DataFrame:
    """Changes of each pair by kind so far; its state is one row for each pair and kind."""
    return changes.groupBy("pair_id", "change_type").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def windowed(events: DataFrame, ts: str, late: str, length: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    """Counts and sums in tumbling or sliding windows. In append mode rows later than ``late`` behind the newest are left out; complete mode keeps all windows, and so all rows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total", "peak")


def sessions(events: DataFrame, ts: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Sessions that end after a gap without events."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def distinct_keys(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch operator (clustering, ranking) over each micro-batch, once for all that is there."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return what came out, as a table in the shared folder.

    In complete mode each batch replaces the table with the windows so far; in append mode
    the closed windows are added to it. Nothing comes to the driver.
    """
    scratch = Scratch(stream.sparkSession, f"stream-{name}")
    path, saved = scratch.path("rows"), "overwrite" if mode == "complete" else "append"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode(saved).parquet(path)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
