"""Filters with counters, limits, ranks, samples and slices of change lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(changes: DataFrame, filters: Sequence[tuple[str, Column]]) -> DataFrame:
    """``excluded_by``: the name of the first filter that a row fails, null for rows that pass all.

    One pass: each filter is an expression, so the counters are one aggregation behind it.
    """
    reason = F.lit(None).cast("string")
    for name, keep in reversed(filters):
        reason = F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)).otherwise(reason)
    return changes.withColumn("excluded_by", reason)


def cascade_counts(marked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in all, rows that pass, and rows that each filter excluded."""
    return marked.agg(F.count("*").alias("total_count"), F.count_if(F.col("excluded_by").isNull()).alias("filtered_count"), *[F.count_if(F.col("excluded_by") == n).alias(f"excluded_by_{n}") for n in names])


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order, each task's own first n before they meet."""
    return df.orderBy(*order).limit(n)


def top_share(df: DataFrame, order: list[Column], percent: float, by: Sequence[str]) -> DataFrame:
    """The first percent of each group, one row at least."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return rows.filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_n")


def ranked(df: DataFrame, by: Sequence[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per(df: DataFrame, by: Sequence[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    return ranked(df, by, order, "_r").filter(F.col("_r") <= k).drop("_r")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins: the last row of each key."""
    return first_per(df, keys, [F.desc(c) for c in order])


def overflow(df: DataFrame, by: str, order: list[Column], limit: int, kind: str) -> DataFrame:
    """Rows kept and left out of each kind when each group keeps its first ``limit`` rows."""
    return ranked(df, [by], order, "_r").groupBy(by, kind).agg(F.count_if(F.col("_r") <= limit).alias("kept"), F.count_if(F.col("_r") > limit).alias("omitted"))


def even_sample(df: DataFrame, by: str, order: Sequence[str], per_group: int) -> DataFrame:
    """At most ``per_group`` rows of each group at even steps of its order: indices round(i n / k)."""
    w = Window.partitionBy(by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    k = F.least(F.col("_n"), F.lit(per_group))
    at = F.floor(F.col("_i") * k / F.col("_n"))
    hit = F.exists(F.array(at - 1, at, at + 1), lambda j: (j >= 0) & (j < k) & (F.rint(j * F.col("_n") / k) == F.col("_i")))
    return rows.filter(hit).drop("_i", "_n")


def pages(df: DataFrame, by: str, order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size pages of each group's rows."""
    return df.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size))


def viewport(points: DataFrame, x0: float, y0: float, x1: float, y1: float, most: int, cell: float) -> DataFrame:
    """What a viewport shows: its points (``n`` 1 each) if there are at most ``most``, else the cells of a grid with their counts.

    The decision stays in the plan, as a one-row aggregate.
    """
    inside = points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    many = inside.agg((F.count("*") > most).alias("many"))
    rows = inside.crossJoin(F.broadcast(many))
    gx, gy = F.floor(F.col("x") / cell).cast("double") * cell, F.floor(F.col("y") / cell).cast("double") * cell
    key = F.when(F.col("many"), F.lit(None)).otherwise(F.col("id"))
    return rows.groupBy(key.alias("id"), F.when(F.col("many"), gx).otherwise(F.col("x")).alias("x"), F.when(F.col("many"), gy).otherwise(F.col("y")).alias("y")).agg(F.count("*").alias("n"))


def visible_tiles(viewports: DataFrame, tile: int, ring: int) -> DataFrame:
    """Tiles that each viewport (``id x0 y0 x1 y1``) touches, with a ring of tiles to fetch ahead."""
    low = lambda c: F.floor(F.col(c) / tile) - ring
    high = lambda c: F.floor(F.col(c) / tile) + ring
    rows = viewports.select("*", F.explode(F.sequence(low("x0"), high("x1"))).alias("tx")).select("*", F.explode(F.sequence(low("y0"), high("y1"))).alias("ty"))
    seen = F.col("tx").between(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile)) & F.col("ty").between(F.floor(F.col("y0") / tile), F.floor(F.col("y1") / tile))
    return rows.select("id", "tx", "ty", (~seen).alias("prefetch"))
