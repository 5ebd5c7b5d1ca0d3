"""Shift and rotation between two revisions, from matched pairs (columns ax, ay, bx, by)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import distance, rotated

#: Rows that the robust fit reads (by hash), its tolerance, least share of inliers and least number of pairs.
SAMPLE, TOLERANCE, LEAST_INLIERS, LEAST_PAIRS = 5000, 0.5, 0.5, 4
#: A transform is significant beyond this shift or angle.
SHIFT, ANGLE = 0.05, 0.01


def at_rank(df: DataFrame, value: Column, index: Column, by: list[str], name: str) -> DataFrame:
    """The value at a 0-based rank of each group, as an exact order statistic.

    ``index`` is an expression over ``n``, the rows of the group.
    """
    w = Window.partitionBy(*by)
    rows = df.select(*by, value.alias("v")).withColumn("r", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w))
    return rows.filter(F.col("r") == index).select(*by, F.col("v").alias(name))


def median_shift(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Median shift of each group (mean of the middle two)."""
    return pairs.groupBy(*by).agg(F.median(F.col("bx") - F.col("ax")).alias("dx"), F.median(F.col("by") - F.col("ay")).alias("dy"), F.count("*").alias("n_pairs"))


def upper_median_shift(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Shift at rank n // 2 of each group."""
    middle = F.expr("n div 2")
    return at_rank(pairs, F.col("bx") - F.col("ax"), middle, by, "dx").join(at_rank(pairs, F.col("by") - F.col("ay"), middle, by, "dy"), by)


def dominant_shift(pairs: DataFrame, by: list[str], least: int = 3, share: float = 0.5) -> DataFrame:
    """The most frequent shift to 3 decimals, if enough pairs and half of them have it; the smaller shift of equals."""
    bucket = [F.rint((F.col("bx") - F.col("ax")) * 1000).cast("long").alias("dx_milli"), F.rint((F.col("by") - F.col("ay")) * 1000).cast("long").alias("dy_milli")]
    counts = pairs.select(*by, *bucket).groupBy(*by, "dx_milli", "dy_milli").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "dx_milli", "dy_milli")))
    return counts.filter((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).drop("r")


def robust_extents(points: DataFrame, by: list[str], low: float = 0.01, least: int = 8) -> DataFrame:
    """Centre of the extents without the outermost hundredth of each coordinate; of all points of small groups."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    rows = points.select(*by, "x", "y", n.alias("n"), (F.row_number().over(w.orderBy("x")) - 1).alias("rx"), (F.row_number().over(w.orderBy("y")) - 1).alias("ry"))
    first = F.when(F.col("n") >= least, F.floor(F.col("n") * low)).otherwise(0)
    last = F.when(F.col("n") >= least, F.least(F.floor(F.col("n") * (1 - low)), F.col("n") - 1)).otherwise(F.col("n") - 1)
    pick = lambda c, r, at: F.max(F.when(F.col(r) == at, F.col(c)))
    out = rows.groupBy(*by).agg(pick("x", "rx", first).alias("x0"), pick("x", "rx", last).alias("x1"), pick("y", "ry", first).alias("y0"), pick("y", "ry", last).alias("y1"), F.first("n").alias("n"))
    return out.select(*by, "n", "x0", "x1", "y0", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


def fit_rigid(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Least-squares shift and angle (degrees) that take points a to b."""
    ca, cb = a.mean(axis=0), b.mean(axis=0)
    p, q = a - ca, b - cb
    angle = np.arctan2((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum(), (p * q).sum())
    c, s = np.cos(angle), np.sin(angle)
    return float(cb[0] - (c * ca[0] - s * ca[1])), float(cb[1] - (s * ca[0] + c * ca[1])), float(np.degrees(angle))


def rigid_transform(pairs: DataFrame, seed: int = 0, rounds: int = 200) -> tuple[float, float, float, float] | None:
    """(dx, dy, angle, inlier share) by random sample consensus on a bounded sample of pairs, or None.

    The sample (``SAMPLE`` pairs, by hash of their coordinates) is what the driver holds;
    the share of inliers that it returns is over all pairs.
    """
    rows = pairs.select("ax", "ay", "bx", "by").orderBy(F.xxhash64("ax", "ay", "bx", "by")).limit(SAMPLE).toPandas().to_numpy(float)
    if len(rows) < LEAST_PAIRS:
        return None
    a, b, rng, best = rows[:, :2], rows[:, 2:], np.random.default_rng(seed), None
    for _ in range(rounds):
        two = rng.choice(len(rows), 2, replace=False)
        if np.allclose(a[two[0]], a[two[1]]):
            continue
        near = _residual(a, b, fit_rigid(a[two], b[two])) <= TOLERANCE
        if best is None or near.sum() > best.sum():
            best = near
    if best is None or best.mean() < LEAST_INLIERS or best.sum() < LEAST_PAIRS:
        return None
    found = fit_rigid(a[best], b[best])
    t = F.struct(F.lit(found[0]).alias("dx"), F.lit(found[1]).alias("dy"), F.lit(found[2]).alias("angle"))
    moved = rotated(F.col("ax"), F.col("ay"), t)
    near = distance(moved["x"], moved["y"], F.col("bx"), F.col("by")) <= TOLERANCE
    return (*found, float(pairs.agg(F.avg(near.cast("double"))).first()[0]))


def _residual(a: np.ndarray, b: np.ndarray, t: tuple[float, float, float]) -> np.ndarray:
    c, s = np.cos(np.radians(t[2])), np.sin(np.radians(t[2]))
    return np.hypot(a[:, 0] * c - a[:, 1] * s + t[0] - b[:, 0], a[:, 0] * s + a[:, 1] * c + t[1] - b[:, 1])


def significant(dx: float, dy: float, angle: float) -> bool:
    return (dx * dx + dy * dy) ** 0.5 > SHIFT or abs(angle) > ANGLE


def inlier_share(pairs: DataFrame, dx: Column, dy: Column, tolerance: float = TOLERANCE) -> Column:
    """Share of pairs that a shift brings within the tolerance, as an aggregate."""
    rx, ry = F.col("ax") + dx - F.col("bx"), F.col("ay") + dy - F.col("by")
    return F.avg((F.sqrt(rx * rx + ry * ry) <= tolerance).cast("double"))
