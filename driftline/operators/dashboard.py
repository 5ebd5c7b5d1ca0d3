"""Summaries of review issues by drawing and by repeated pattern, and lookups of a run's artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.zones import top_values

#: Issues of a drawing's queue and of its priority without any, drawings and zones a pattern names, layers named (fixed values).
QUEUE, SEED, DRAWINGS, ZONES, DRAWING_LAYERS, PATTERN_LAYERS = 5, 5, 8, 5, 4, 5
CORE = ("rebar", "member", "grid", "dimension", "mixed")


def drawing_summary(issues: DataFrame, layers: DataFrame) -> DataFrame:
    """Per drawing: counts, and a priority from its first structural issues (or its first issues), its changes and its zones.

    ``issues`` has ``pair_id zone_id priority_score raw_change_count severity category folded``;
    ``layers`` has ``pair_id layer``, a row for each issue and layer.
    """
    order = [F.desc("priority_score"), F.col("zone_id")]
    core = F.col("category").isin(*CORE)
    rows = issues.withColumn("_core", core).withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy(*order))).withColumn("_c", F.row_number().over(Window.partitionBy("pair_id", "_core").orderBy(*order)))
    agg = rows.groupBy("pair_id").agg(
        F.count("*").alias("zone_count"), F.sum("raw_change_count").alias("raw_change_count"), F.count_if("_core").alias("structural_count"), F.count_if("folded").alias("folded_count"), F.count_if(F.lower("severity") == "high").alias("high_count"),
        F.sum(F.when(F.col("_core") & (F.col("_c") <= QUEUE), F.col("priority_score"))).alias("_seed"), F.sum(F.when(F.col("_r") <= SEED, F.col("priority_score"))).alias("_first"),
    )
    score = F.coalesce("_seed", "_first") + F.col("raw_change_count") * 0.01 + F.col("zone_count") * 0.05
    names = top_values(layers, ["pair_id"], "layer", DRAWING_LAYERS, "major_layers")
    return agg.withColumn("priority_score", F.round(score, 3)).drop("_seed", "_first").join(names, "pair_id", "left")


def pattern_summary(issues: DataFrame, layers: DataFrame) -> DataFrame:
    """Per repeated pattern: changes, zones, distinct drawings, the first of them by name, its frequent layers, its first zones.

    ``issues`` has ``pattern drawing zone_id raw_change_count place`` (``place``: the order of issues);
    ``layers`` has ``pattern layer``.
    """
    rows = issues.filter("pattern <> ''")
    agg = rows.groupBy("pattern").agg(F.sum("raw_change_count").alias("raw_change_count"), F.count("*").alias("zone_count"), F.count_distinct("drawing").alias("drawings"))
    by = lambda order: F.row_number().over(Window.partitionBy("pattern").orderBy(*order))
    joined = lambda df, value, name: df.groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]), " | ").alias(name))
    drawings = rows.filter("drawing <> ''").select("pattern", "drawing").distinct().withColumn("_r", by(["drawing"])).filter(F.col("_r") <= DRAWINGS)
    zones = rows.withColumn("_r", by(["place"])).filter(F.col("_r") <= ZONES).withColumn("zone", F.concat_ws(":", "drawing", F.col("zone_id").cast("string")))
    frequent = top_values(layers.filter("pattern <> ''"), ["pattern"], "layer", PATTERN_LAYERS, "top_layers")
    return agg.join(joined(drawings, "drawing", "top_drawings"), "pattern", "left").join(joined(zones, "zone", "zones"), "pattern", "left").join(frequent, "pattern", "left")


def with_artifacts(zones: DataFrame, artifacts: DataFrame, columns: list[str]) -> DataFrame:
    """Zones with columns of their pair's artifact; of a pair's artifacts the last (``ordinal``) counts."""
    last = artifacts.groupBy("pair_id").agg(*[F.max_by(c, "ordinal").alias(c) for c in columns])
    return zones.join(last, "pair_id", "left")


def viewer_summary(events: DataFrame, stages: list[str]) -> DataFrame:
    """Rows, cache hits and the median and 95th percentile of each stage's times, a row for every stage asked for (zeros without events)."""
    agg = events.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("cache_hit").alias("hits"), F.percentile("elapsed_ms", 0.5).alias("p50"), F.percentile("elapsed_ms", 0.95).alias("p95"), F.max("elapsed_ms").alias("worst"))
    wanted = events.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    rows = F.broadcast(wanted).join(agg, "stage", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return rows.select("stage", zero("n", 0), zero("hits", 0), zero("p50", 0.0), zero("p95", 0.0), zero("worst", 0.0), F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("hit_rate"))


def first_latency(stream: DataFrame, started: str = "started", written: str = "written") -> DataFrame:
    """Time from the start of each run to its first record: whole microseconds, and seconds."""
    us = F.unix_micros(F.min(written)) - F.unix_micros(F.min(started))
    return stream.groupBy("run_id").agg(us.alias("first_record_us"), (us / 1e6).alias("first_record_s"), F.count("*").alias("n"))
