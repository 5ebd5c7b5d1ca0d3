"""Spatial joins over grid cells: an equi-join on (group, cell) with an exact test behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import box_gap, distance, iou
from driftline.operators.assign import classes
from driftline.plans.scratch import Scratch

#: Cells that a box may cover before it goes to the coarser grid.
MOST_CELLS = 4096


def near_points(left: DataFrame, right: DataFrame, radius: Column | float, cell: float, on: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of points at most ``radius`` apart, within equal ``on``.

    Both sides have the columns ``id``, ``x``, ``y`` and ``on``; the result has ``{a}_id``,
    ``{b}_id``, ``distance`` and ``on``. Only the right side is copied, to the nine cells
    around its own; ``cell`` must be at least the radius. A point owns one cell, so no
    pair comes twice. The copies are many more rows than the files' sizes tell, so the
    join is never a broadcast.
    """
    key = [*on, "gx", "gy"]
    gx, gy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    one = left.select(*on, F.col("id").alias(f"{a}_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), gx.alias("gx"), gy.alias("gy"), *_others(left, on, a))
    around = F.explode(F.array(*[F.struct((gx + i).alias("gx"), (gy + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    two = right.select(*on, F.col("id").alias(f"{b}_id"), F.col("x").alias("bx"), F.col("y").alias("by"), around.alias("g"), *_others(right, on, b)).select("*", "g.gx", "g.gy").drop("g")
    pairs = one.join(two.hint("merge"), key).withColumn("distance", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return pairs.filter(F.col("distance") <= radius).drop("gx", "gy", "ax", "ay", "bx", "by")


def _others(df: DataFrame, on: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in {*on, "id", "x", "y"}]


def near_points_plain(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """The same for ids and distances alone, with cells of the radius itself: a join on ``on`` alone would grow with the square of its groups."""
    one, two = left.select(*on, "id", "x", "y"), right.select(*on, "id", "x", "y")
    return near_points(one, two, radius, radius if radius > 0 else 1.0, on).select(*on, "a_id", "b_id", "distance")


def near_places(left: DataFrame, right: DataFrame, radius: Column | float, cell: float, on: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``near_points`` of places (the smallest id of each), and the members of the places of both sides."""
    (one, a), (two, b) = (classes(side, [*on, "x", "y"]) for side in (left, right))
    return near_points(one, two, radius, cell, on), a, b


def in_square(left: DataFrame, right: DataFrame, tolerance: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of points whose coordinates differ by at most the tolerance each."""
    wide = left.select(*on, F.col("id").alias("a_id"), "x", "y", F.floor(F.col("x") / tolerance).alias("gx"), F.floor(F.col("y") / tolerance).alias("gy"))
    around = F.explode(F.array(*[F.struct((F.floor(F.col("x") / tolerance) + i).alias("gx"), (F.floor(F.col("y") / tolerance) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = right.select(*on, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), around.alias("g")).select("*", "g.gx", "g.gy").drop("g")
    pairs = wide.join(near.hint("merge"), [*on, "gx", "gy"])
    return pairs.filter((F.abs(F.col("x") - F.col("bx")) <= tolerance) & (F.abs(F.col("y") - F.col("by")) <= tolerance)).select(*on, "a_id", "b_id")


def near_boxes(left: DataFrame, right: DataFrame, radius: float, cell: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of boxes with a gap of at most ``radius``: ``a_id``, ``b_id``, ``gap``, ``iou``.

    Both sides have ``id``, ``box`` and ``on``. Cells are copied on both sides, so a pair
    that shares several cells is kept only in the one that holds the lower corner of
    what they share. Boxes over too many cells meet the others on a grid whose cells
    cover a whole cap of the first.
    """

    def cells(df: DataFrame, side: str, grow: float, size: float) -> DataFrame:
        b = F.col("box")
        x = F.sequence(F.floor((b["x0"] - grow) / size), F.floor((b["x1"] + grow) / size))
        y = F.sequence(F.floor((b["y0"] - grow) / size), F.floor((b["y1"] + grow) / size))
        return df.select(*on, F.col("id").alias(f"{side}_id"), b.alias(f"{side}_box"), F.explode(x).alias("gx"), y.alias("ys")).withColumn("gy", F.explode("ys")).drop("ys")

    def covered(size: float) -> Column:
        b = F.col("box")
        return ((b["x1"] - b["x0"] + 2 * radius) / size + 2) * ((b["y1"] - b["y0"] + 2 * radius) / size + 2)

    def joined(one: DataFrame, two: DataFrame, size: float) -> DataFrame:
        pairs = cells(one, "a", radius, size).join(cells(two, "b", 0.0, size).hint("merge"), [*on, "gx", "gy"])
        low_x = F.floor(F.greatest(F.col("a_box.x0") - radius, F.col("b_box.x0")) / size)
        low_y = F.floor(F.greatest(F.col("a_box.y0") - radius, F.col("b_box.y0")) / size)
        pairs = pairs.filter((F.col("gx") == low_x) & (F.col("gy") == low_y))
        pairs = pairs.withColumn("gap", box_gap(F.col("a_box"), F.col("b_box"))).filter(F.col("gap") <= radius)
        return pairs.select(*on, "a_id", "b_id", "gap", iou(F.col("a_box"), F.col("b_box")).alias("iou"))

    small = covered(cell) <= MOST_CELLS
    coarse = cell * MOST_CELLS**0.5
    la, lb, ra, rb = left.filter(small), left.filter(~small), right.filter(small), right.filter(~small)
    return joined(la, ra, cell).unionByName(joined(lb, right, coarse)).unionByName(joined(la, rb, coarse))


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float, on: Sequence[str] = (), most: float | None = None, apart: bool = False) -> DataFrame:
    """The k nearest right points of each left point: ``a_id``, ``b_id``, ``distance``, ``rank``.

    They are looked for within ``radius`` first; points that find fewer look again within
    four times that, until all have k or the radius covers all points, so sparse points
    cost rounds and dense ones don't. ``most`` ends the search at that distance; with ``apart``
    no point is its own neighbour. Rounds are written to the shared folder.
    """
    scratch = Scratch(left.sparkSession, "nearest")
    if (reach := most) is None:
        edge = left.select("x", "y").unionByName(right.select("x", "y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        reach = 0.0 if edge[0] is None else ((edge[2] - edge[0]) ** 2 + (edge[3] - edge[1]) ** 2) ** 0.5
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("distance", "b_id"))
    out, rest, n = None, left, 0
    while True:
        pairs = near_points(rest, right, radius, radius, on)
        found = scratch.write((pairs.filter("a_id <> b_id") if apart else pairs).withColumn("rank", rank).filter(F.col("rank") <= k), f"found-{n}")
        full = found.filter(F.col("rank") == k).select(F.col("a_id").alias("id"))
        last = radius >= reach
        done = found if last else found.join(full.withColumnRenamed("id", "a_id").hint("merge"), "a_id", "left_semi").select(*found.columns)
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rest = scratch.write(rest.join(full.hint("merge"), "id", "left_anti").select(*left.columns), f"rest-{n}")
        if rest.isEmpty():
            return out
        radius, n = radius * 4 if most is None else min(radius * 4, most), n + 1


def in_window(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in a viewport; the bounds reach the scan."""
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
