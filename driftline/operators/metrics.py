"""Accuracy, burden, telemetry and accounting as single aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, predicted: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1 and noise; null where a denominator is 0."""
    n = rows.groupBy(*by).agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"))
    shown, real = F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    n = n.withColumns({"precision": F.col("tp") / shown, "recall": F.col("tp") / real, "noise_ratio": F.col("fp") / shown})
    return n.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def sheet_accuracy(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], manual: str) -> DataFrame:
    """Of pair sets, without manual rows; a zero denominator gives 1."""
    p = predicted.filter(~F.col(manual)).select(*keys).distinct().withColumn("p", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    n = p.join(t, list(keys), "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("p").alias("n_predicted"), F.count("t").alias("n_truth"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a / b)))
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("n_predicted")), "recall": ratio(F.col("tp"), F.col("n_truth"))})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: Words of a decision (fixed values); any other word holds.
CONFIRMED, REJECTED = ("confirmed", "confirm", "true_positive", "tp"), ("false_positive", "fp", "rejected", "reject")


def decision(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*CONFIRMED), "confirmed").when(word.isin(*REJECTED), "false_positive").otherwise("hold")


def burden(decisions: DataFrame, top: int, minutes: float = 0.5) -> DataFrame:
    """Precision, precision among the first ranks, and what a sheet costs. ``decisions`` has ``decision rank sheet_id``."""
    d, first = F.col("decision"), F.col("rank").between(1, top)
    n = decisions.agg(
        F.count("*").alias("total_decisions"), F.count_if(d == "confirmed").alias("confirmed"), F.count_if(d == "false_positive").alias("false_positive"), F.count_if(d == "hold").alias("hold"),
        F.count_distinct("sheet_id").alias("sheets"), F.count_if(first & (d == "confirmed")).alias("top_confirmed"), F.count_if(first & (d == "false_positive")).alias("top_false_positive"),
    )
    share = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    sheets = F.nullif(F.col("sheets"), F.lit(0))
    return n.withColumns({"precision": share("confirmed", "false_positive"), "top_precision": share("top_confirmed", "top_false_positive"), "false_positive_per_sheet": F.col("false_positive") / sheets, "minutes_per_sheet": F.col("total_decisions") * minutes / sheets})


def percentiles(events: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact interpolated p50, p95 and p99, mean and maximum of values that are not negative."""
    ok = events.filter(F.col(value) >= 0)
    p = ok.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.avg(value).alias("mean"), F.max(value).alias("peak"))
    return p.select(*by, "n", F.get("p", 0).alias("p50"), F.get("p", 1).alias("p95"), F.get("p", 2).alias("p99"), "mean", "peak")


def cache_stats(events: DataFrame, by: Sequence[str], hit: Column, key: str) -> DataFrame:
    """Hits, misses, hit rate to 4 decimals (0 without any), and repeated keys."""
    n = events.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), (F.count(key) - F.count_distinct(key)).alias("duplicate_keys"))
    return n.withColumn("hit_rate", F.coalesce(F.bround(F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), 4), F.lit(0.0)))


def shortfalls(actual: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Requirements that are not met; what is missing altogether counts 0. ``actual`` has ``n``, ``required`` has ``least``."""
    rows = required.join(actual, key, "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return rows.filter(F.col("actual") < F.col("least")).select(key, "least", "actual", (F.col("least") - F.col("actual")).alias("missing"))


def zero_filled(counts: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Counts of fixed categories, 0 for those without any. ``counts`` has ``n``."""
    return categories.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def audit(stats: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Counters of one row as labelled rows, without those of 0."""
    pairs = ", ".join(f"'{label}', CAST({column} AS BIGINT)" for column, label in labels.items())
    return stats.selectExpr(f"stack({len(labels)}, {pairs}) AS (label, n)").filter("n > 0")


def failure_codes(items: DataFrame, codes: str, order: Sequence[str]) -> DataFrame:
    """Distinct codes over all rows' arrays, in the order of first appearance."""
    rows = items.select(*order, F.posexplode(codes).alias("at", "code"))
    first = rows.groupBy("code").agg(F.min(F.struct(*order, "at")).alias("first"), F.count("*").alias("n"))
    return first.select("code", "n", "first.*")


def accounting(rows: DataFrame, side: Column, centre: Column, total: Column) -> DataFrame:
    """Both sides, the centre and the rest of a stated total, which reconciles when the rest is 0."""
    return rows.withColumn("both_sides", side * 2).withColumn("residual", total - side * 2 - centre).withColumn("reconciles", F.abs(total - side * 2 - centre) <= 1e-9)


def reconcile(actual: DataFrame, golden: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """PASS or FAIL for each key of either side, by the difference of the values; a missing side fails."""
    rows = golden.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "full_outer")
    return rows.withColumn("status", F.when(F.abs(F.col("expected") - F.col("actual")) <= tolerance, "PASS").otherwise("FAIL"))
