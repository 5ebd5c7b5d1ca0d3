"""Clusters of changes, their aggregates, and what links or folds them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.classify import ANNOTATION, SEVERE_LAYERS, only_moves, severity, zone_change_type
from driftline.functions.geometry import box_gap, distance
from driftline.functions.text import is_structural
from driftline.operators.assign import classes, greedy_classes
from driftline.operators.graph import components
from driftline.operators.spatial import near_boxes, near_points
from driftline.plans.scratch import Scratch

#: Gap within a cluster, rows and span of a mega cluster, its grid, rows of a chunk (fixed values).
GAP, MEGA_ROWS, MEGA_SPAN, GRID, CHUNK = 250.0, 5000, 50_000.0, 20_000.0, 5000
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def clusters(boxes: DataFrame, gap: float, cell: float, on: Sequence[str] = ()) -> DataFrame:
    """``id`` and ``zone`` (smallest id) of boxes linked by gaps of at most ``gap``, within ``on``; alone, a box is its own zone.

    Equal boxes are in one zone, so only the smallest id of each is joined; a box with a null or NaN is alone.
    """
    scratch = Scratch(boxes.sparkSession, "clusters")
    b = F.col("box")
    whole = F.coalesce((b["x0"] + b["y0"] + b["x1"] + b["y1"]).isNotNull() & (box_gap(b, b) <= gap), F.lit(False))
    alike = scratch.write(boxes.filter(whole).groupBy(*on, "box").agg(F.min("id").alias("first")), "alike")
    one = alike.select(*on, F.col("first").alias("id"), "box")
    of = components(near_boxes(one, one, gap, cell, on).filter("a_id > b_id"), "a_id", "b_id")
    zone = alike.join(of.hint("merge"), alike["first"] == of["node"], "left").select(*on, "box", F.coalesce("component", "first").alias("_zone"))
    rows = boxes.select(*on, "id", F.when(whole, F.col("box")).alias("box")).join(zone.hint("merge"), [*on, "box"], "left")
    return rows.select(*on, "id", F.coalesce("_zone", "id").alias("zone"))


def islands(df: DataFrame, by: Sequence[str], start: Column, end: Column, gap: float, order: Sequence[str]) -> DataFrame:
    """One-dimensional clusters: ``island`` counts up where a row starts more than ``gap`` after all ends before it."""
    w = Window.partitionBy(*by).orderBy("_s", "_e", *order)
    rows = df.withColumn("_s", start).withColumn("_e", end)
    rows = rows.withColumn("_reach", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + gap)).cast("int"))
    return rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach", "_new")


def merged_intervals(df: DataFrame, by: Sequence[str], start: Column, end: Column, gap: float = 0.0, order: Sequence[str] = ()) -> DataFrame:
    """Union of intervals of each group: ``start``, ``end`` and how many went in."""
    return islands(df, by, start, end, gap, order).groupBy(*by, "island").agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.count("*").alias("n")).drop("island")


def coverage(merged: DataFrame, by: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Share of [low, high] that merged intervals cover."""
    inside = F.greatest(F.least(F.col("end"), high) - F.greatest(F.col("start"), low), F.lit(0.0))
    return merged.groupBy(*by).agg((F.sum(inside) / F.first(high - low)).alias("coverage"), F.count("*").alias("n_intervals"))


def split_mega(rows: DataFrame, zone: str, order: Sequence[str], most: int = MEGA_ROWS, span: float = MEGA_SPAN, grid: float = GRID, chunk: int = CHUNK) -> DataFrame:
    """``part`` of each row of its zone: 0 for ordinary zones; cells and chunks of the cells for zones too large or too wide.

    ``rows`` has ``x`` and ``y``.
    """
    w = Window.partitionBy(zone)
    wide = (F.max("x").over(w) - F.min("x").over(w) > span) | (F.max("y").over(w) - F.min("y").over(w) > span)
    rows = rows.withColumn("_mega", (F.count("*").over(w) > most) | wide)
    rows = rows.withColumn("_gx", F.when(F.col("_mega"), F.floor(F.col("x") / grid)).otherwise(0)).withColumn("_gy", F.when(F.col("_mega"), F.floor(F.col("y") / grid)).otherwise(0))
    n = F.row_number().over(Window.partitionBy(zone, "_gx", "_gy").orderBy("y", "x", *order))
    return rows.withColumn("part", F.when(F.col("_mega"), F.floor((n - 1) / chunk)).otherwise(0)).select(*[c for c in rows.columns if not c.startswith("_")], F.col("_gx").alias("cell_x"), F.col("_gy").alias("cell_y"), "part")


def summaries(changes: DataFrame, zone: Sequence[str]) -> DataFrame:
    """One row per zone: box, counts by kind, structure, severity and why, and type.

    ``changes`` has ``x0 y0 x1 y1 change_type entity_type layer``, and may have ``moved`` (its
    origin has moved) and ``category``. A zone in which annotation has merely moved, on no
    structural layer, is low; else dimensions make it critical, severe layers and 100
    changes high. All of it is one aggregation that combines before the shuffle.
    """
    kind = lambda k: F.count_if(F.col("change_type") == k)
    moved = F.coalesce(F.col("moved"), F.lit(False)) if "moved" in changes.columns else F.lit(False)
    category = F.col("category") if "category" in changes.columns else F.lit("")
    entity = F.upper(F.coalesce("entity_type", F.lit("")))
    agg = changes.groupBy(*zone).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"), kind("added").alias("n_added"),
        kind("deleted").alias("n_deleted"), kind("modified").alias("n_modified"), F.count_if(F.col("entity_type") == "DIMENSION").alias("n_dimension"),
        F.coalesce(F.bool_or(F.rlike(F.upper("layer"), F.lit(SEVERE_LAYERS))), F.lit(False)).alias("structural"), F.count_distinct("layer").alias("n_layers"),
        F.bool_or(moved).alias("_moved"), (F.bool_and((entity == "") | entity.isin(*ANNOTATION)) & F.bool_or(entity != "") & ~F.coalesce(F.bool_or(is_structural(F.col("layer"))), F.lit(False)) & F.bool_and(only_moves(category))).alias("_notes"),
    )
    agg = agg.withColumn("change_type", zone_change_type(F.col("n_added"), F.col("n_deleted"), F.col("n_modified"), F.col("_moved") & (F.col("n_modified") > 0)))
    notes = F.col("_notes") & (F.col("change_type") == "moved")
    level = severity(F.col("n"), F.col("n_dimension"), F.col("n_deleted"), F.col("n_modified"), F.col("structural"), notes)
    why = F.when(notes, "annotation reposition").when(F.col("n_dimension") > 0, "contains dimension changes").when(F.col("structural"), "contains structural layer changes").when(F.col("n") >= 100, "large clustered change").otherwise("")
    return agg.withColumn("severity", level).withColumn("reason", why).drop("_moved", "_notes")


def top_values(df: DataFrame, by: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """The k most frequent values of each group, most frequent first, then by value, as one text."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    return counts.withColumn("r", rank).filter(F.col("r") <= k).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"]), ", ").alias(name))


def first_values(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], k: int, name: str) -> DataFrame:
    """The first k distinct values of each group in the given order, as one text."""
    first = df.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("at"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("at", value))
    return first.withColumn("r", rank).filter(F.col("r") <= k).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"]), ", ").alias(name))


#: Parts over which zones of one size and count are dealt at most, and zones of a part.
MOST_PARTS, PART_ROWS = 64, 500
#: Sizes of relocated zones differ by this much, or by this share of the larger one, at most (fixed values).
SIZE_GAP, SIZE_SHARE = 2.0, 0.01
#: Pairs of zones of one size that are made at once; zones that a reach is taken from, and how many others are within it as a rule.
FEW_PAIRS, PROBES, NEAREST = 2_000_000, 64, 8


def _size_bucket(size: Column) -> Column:
    """Numbers whose floors differ by one at most for sizes that count as equal: even steps, then steps of a share."""
    edge = SIZE_GAP / SIZE_SHARE
    steps = F.when(size < edge, size / SIZE_GAP).otherwise(edge / SIZE_GAP + F.log(F.greatest(size, F.lit(edge)) / edge) / -math.log(1 - SIZE_SHARE))
    return F.floor(steps / 1.02)


def _dealt(gone: DataFrame, come: DataFrame, key: list[str]) -> DataFrame:
    """The equi-join of both on ``key``: rows of ``gone`` that share a key are dealt over parts, and those of ``come`` copied to each part.

    Zones of one size and count are small files and their pairs are not, so the tasks are neither broadcast nor merged.
    """
    n = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = gone.groupBy(*key).agg(F.least(F.lit(MOST_PARTS), F.ceil(F.count("*") / PART_ROWS)).cast("int").alias("_parts")).hint("merge")
    one = gone.join(parts, key).withColumn("_part", F.pmod(F.xxhash64("a_id"), F.col("_parts")).cast("int")).drop("_parts").repartition(n, *key, "_part")
    two = come.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").repartition(n, *key, "_part")
    return two.join(one.hint("merge"), [*key, "_part"]).drop("_part")


def _sides(zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zones of which all is deleted and those of which all is added, with how many as ``n``."""
    gone = zones.filter("change_type = 'deleted' AND n_deleted > 0 AND n_added = 0").withColumn("n", F.col("n_deleted"))
    return gone, zones.filter("change_type = 'added' AND n_added > 0 AND n_deleted = 0").withColumn("n", F.col("n_added"))


def relocation_candidates(zones: DataFrame) -> DataFrame:
    """Deleted and added zones with equal counts and sizes that count as equal.

    ``zones`` has ``id x y width height n_added n_deleted`` and ``change_type``; ``x`` and ``y`` are
    centroids. An equi-join on the count and the buckets of width and height (neighbours copied on one
    side), then the exact test.
    """
    gone, come = _sides(zones)
    gone = gone.select(
        F.col("id").alias("a_id"), "n", F.col("width").alias("aw"), F.col("height").alias("ah"), F.col("x").alias("ax"), F.col("y").alias("ay"), _size_bucket(F.col("width")).alias("kw"), _size_bucket(F.col("height")).alias("kh")
    )
    near = lambda size: F.explode(F.array(*[_size_bucket(F.col(size)) + i for i in (-1, 0, 1)]))
    come = come.select(F.col("id").alias("b_id"), "n", F.col("width").alias("bw"), F.col("height").alias("bh"), F.col("x").alias("bx"), F.col("y").alias("by"), near("width").alias("kw"))
    pairs = _dealt(gone, come.withColumn("kh", near("bh")), ["n", "kw", "kh"]).drop("kw", "kh")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(SIZE_GAP), SIZE_SHARE * F.greatest(F.col(a), F.col(b)))
    pairs = pairs.filter(close("aw", "bw") & close("ah", "bh"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return pairs.withColumns({"size_diff": F.abs(F.col("aw") - F.col("bw")) + F.abs(F.col("ah") - F.col("bh")), "distance": F.sqrt(dx * dx + dy * dy), "dx": dx, "dy": dy})


_SIZE = ["n", "width", "height"]
_LINK_ORDER = ["size_diff", "distance", "a_id", "b_id"]


def _reach(one: DataFrame, two: DataFrame) -> float | None:
    """A distance within which zones have a few others of their size, from some zones of the size with most pairs; None if all pairs of one size are few."""
    n_one, n_two = (side.groupBy(*_SIZE).agg(F.count("*").alias(n)) for side, n in ((one, "_one"), (two, "_two")))
    pairs = n_one.join(n_two.hint("merge"), _SIZE).withColumn("_pairs", F.col("_one") * F.col("_two"))
    total, most = pairs.agg(F.sum("_pairs"), F.max_by(F.struct(*_SIZE), "_pairs")).first()
    if (total or 0) <= FEW_PAIRS:
        return None
    of = reduce(and_, [F.col(c) == F.lit(most[c]) for c in _SIZE])
    probes = one.filter(of).orderBy(F.xxhash64("id"), "id").limit(PROBES).select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    some = two.filter(of & (F.pmod(F.xxhash64("id"), F.lit(NEAREST)) == 0))
    near = some.crossJoin(F.broadcast(probes)).groupBy("_id").agg(F.min(distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))).alias("d")).collect()
    return sorted(r["d"] for r in near)[len(near) // 2] or None if near else None


def _same_size(one: DataFrame, two: DataFrame, reach: float | None) -> DataFrame:
    """Pairs of zones of one count and size, within ``reach``, with the columns of ``relocation_candidates``."""
    c = F.col
    one, two = (side.select("id", "x", "y", *_SIZE, c("x").alias("px"), c("y").alias("py")) for side in (one, two))
    if reach is None:
        names = lambda side, p: side.select(*_SIZE, c("id").alias(f"{p}_id"), c("px").alias(f"{p}_px"), c("py").alias(f"{p}_py"))
        pairs = names(one, "a").join(names(two, "b").hint("merge"), _SIZE).withColumn("distance", distance(c("a_px"), c("a_py"), c("b_px"), c("b_py")))
    else:
        pairs = near_points(one, two, reach, reach, _SIZE)
    w, h = c("width"), c("height")
    return pairs.select(
        "n", "b_id", w.alias("bw"), h.alias("bh"), c("b_px").alias("bx"), c("b_py").alias("by"), "a_id", w.alias("aw"), h.alias("ah"), c("a_px").alias("ax"), c("a_py").alias("ay"),
        F.lit(0.0).alias("size_diff"), "distance", (c("b_px") - c("a_px")).alias("dx"), (c("b_py") - c("a_py")).alias("dy"),
    )


def _left(side: DataFrame, found: DataFrame, end: str, scratch: Scratch, name: str) -> DataFrame:
    """Members that are not in ``found``."""
    return scratch.write(side.join(found.select(F.col(end).alias("id")).hint("merge"), "id", "left_anti").select("cls", "id"), name)


def relocations(zones: DataFrame) -> DataFrame:
    """One-to-one links of relocated zones: smallest difference in size first, then nearest; each zone once.

    Zones that are alike in all that is compared are one in the join. Those of one size come
    first in the order, and nearest first among them: they are joined within a reach that
    grows from round to round while fewer are left, so that not all pairs of a size
    are made. Behind that one side of each size is used up, and what is left meets other sizes.
    """
    scratch = Scratch(zones.sparkSession, "relocations")
    keys = ["change_type", "n_added", "n_deleted", "x", "y", "width", "height"]
    rows = scratch.write(zones.filter(F.col("change_type").isin("deleted", "added")).select("id", *keys), "zones")
    alike, members = classes(rows, keys)
    alike = scratch.write(alike, "alike")
    known = lambda side: side.select(F.col("id").alias("cls")).hint("merge")
    a, b = (scratch.write(members.join(known(side), "cls", "left_semi").select("cls", "id"), name) for side, name in zip(_sides(alike), ("a", "b"), strict=True))
    whole = reduce(and_, [F.col(k).isNotNull() & (F.abs(k) < float("inf")) for k in ("x", "y", "width", "height")])
    out, n, reach = None, 0, 0.0
    while reach is not None and (n or alike.filter(~F.coalesce(whole, F.lit(False))).isEmpty()):
        free = lambda side, of: side.join(of.select(F.col("cls").alias("id")).distinct().hint("merge"), "id", "left_semi").select("id", "x", "y", *_SIZE)
        one, two = (scratch.write(free(side, of), f"{name}-free-{n}") for side, of, name in zip(_sides(alike), (a, b), "ab", strict=True))
        now = _reach(one, two)
        reach = now and max(now, 2 * reach)
        found = greedy_classes(scratch.write(_same_size(one, two, reach), f"same-{n}"), a, b, _LINK_ORDER)
        found = scratch.write(found, f"found-{n}")
        out, n = found if out is None else out.unionByName(found), n + 1
        a, b = _left(a, found, "a_id", scratch, f"a-{n}"), _left(b, found, "b_id", scratch, f"b-{n}")
    rest = alike.join(a.unionByName(b).select(F.col("cls").alias("id")).distinct().hint("merge"), "id", "left_semi") if n else alike
    found = greedy_classes(relocation_candidates(rest), a, b, _LINK_ORDER)
    return found if out is None else out.unionByName(found)


def folded(zones: DataFrame, keys: Sequence[str], order: Sequence[str], least: int = 3) -> DataFrame:
    """Groups of equal keys: their first zone and size; groups of ``least`` and more are folded into it."""
    w = Window.partitionBy(*keys)
    return zones.withColumn("members", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("is_folded", (F.col("members") >= least) & (F.col("place") > 1))


def capped(zones: DataFrame, pair: str, order: list[Column], per_pair: int, total: int, selected: Column) -> DataFrame:
    """``reason`` why a zone is left out: ``not_selected``, ``max_region_cap`` of its pair, ``max_total_region_cap``; null if it stays.

    The overall rank is taken only among the rows that the pair's cap leaves.
    """
    rows = zones.withColumn("_sel", selected)
    rows = rows.withColumn("_r", F.when(F.col("_sel"), F.row_number().over(Window.partitionBy(pair, "_sel").orderBy(*order))))
    inside = F.col("_sel") & (F.col("_r") <= per_pair)
    rows = rows.withColumn("_in", inside)
    best = rows.filter("_in").orderBy(*order, pair).limit(total).select(pair, "id", F.lit(True).alias("_kept"))
    out = rows.join(best, [pair, "id"], "left")
    reason = F.when(~F.col("_sel"), "not_selected").when(F.col("_r") > per_pair, "max_region_cap").when(F.col("_kept").isNull(), "max_total_region_cap")
    return out.withColumn("reason", reason).drop("_sel", "_r", "_in", "_kept")
