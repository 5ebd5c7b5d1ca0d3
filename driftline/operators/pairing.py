"""Pairing of files, pages and regions from several signals, and manual overrides of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds and floors (fixed values).
AUTO, REVIEW, MISMATCH_CAP, BOOST, BOOST_TITLE, AMBIGUOUS = 0.85, 0.60, 0.59, 0.92, 0.70, 0.10
REGION_AUTO, REGION_REVIEW, REGION_MARGIN = 0.82, 0.60, 0.12


def unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def number_score(a: Column, b: Column) -> Column:
    """1 for equal drawing numbers, 0 for different ones, 0.5 if one is missing."""
    x, y = F.upper(F.trim(F.coalesce(a, F.lit("")))), F.upper(F.trim(F.coalesce(b, F.lit(""))))
    return F.when((x == "") | (y == ""), 0.5).when(x == y, 1.0).otherwise(0.0)


def page_score(number: Column, title: Column, visual: Column, text: Column, size: Column) -> Column:
    """Weighted signals; capped for differing numbers, raised for equal numbers and similar titles."""
    score = 0.35 * number + 0.25 * title + 0.20 * visual + 0.15 * text + 0.05 * size
    score = F.when(number == 0, F.least(score, F.lit(MISMATCH_CAP))).otherwise(score)
    return unit(F.when((number >= 1) & (title >= BOOST_TITLE), F.greatest(score, F.lit(BOOST))).otherwise(score))


def file_score(name: Column, sheet: Column, text: Column, content: Column, path: Column, same_key: Column, same_number: Column, other_number: Column) -> Column:
    score = 0.35 * name + 0.20 * sheet + 0.20 * text + 0.20 * content + 0.05 * path
    score = F.when(same_key, F.greatest(score, F.lit(0.88))).otherwise(score)
    score = F.when(same_number & (sheet >= 0.8), F.greatest(score, F.lit(0.86))).otherwise(score)
    return unit(F.when(other_number, F.least(score, F.lit(MISMATCH_CAP))).otherwise(score))


def region_score(number: Column, title: Column, geometry: Column, histogram: Column, method: Column, other_number: Column, no_identity: Column) -> Column:
    score = number * 0.30 + title * 0.20 + geometry * 0.20 + histogram * 0.25 + method * 0.05
    score = F.when(other_number, F.least(score, F.lit(0.49))).otherwise(score)
    fallback = F.least(F.lit(0.82), geometry * 0.35 + histogram * 0.45 + method * 0.10)
    return unit(F.when(no_identity & (title < 0.2), F.greatest(score, fallback)).otherwise(score))


def status(score: Column, margin: Column | None = None, auto: float = AUTO, review: float = REVIEW, least_margin: float = AMBIGUOUS) -> Column:
    """AUTO_CONFIRMED, REVIEW_REQUIRED or UNMATCHED; a narrow margin to the next asks for review."""
    sure = score >= auto if margin is None else (score >= auto) & (margin >= least_margin)
    return F.when(sure, "AUTO_CONFIRMED").when(score >= review, "REVIEW_REQUIRED").otherwise("UNMATCHED")


def blocked_pairs(a: DataFrame, b: DataFrame, keys: Sequence[Column], a_id: str, b_id: str) -> DataFrame:
    """Candidate pairs that share at least one blocking key, each once: no cross product of the two sides."""
    key = lambda: F.explode(F.array_distinct(F.array_compact(F.array(*keys))))
    one = a.select(F.col(a_id).alias("a_id"), key().alias("block"))
    two = b.select(F.col(b_id).alias("b_id"), key().alias("block"))
    return one.join(two, "block").select("a_id", "b_id").distinct()


def unmatched(side: DataFrame, id_col: str, chosen: DataFrame, end: str) -> DataFrame:
    """Rows of a side that no chosen pair holds."""
    return side.join(chosen.select(F.col(end).alias(id_col)), id_col, "left_anti")


def last_wins(overrides: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return overrides.withColumn("_r", rank).filter("_r = 1").drop("_r")


def apply_overrides(candidates: DataFrame, overrides: DataFrame, order: Sequence[str], a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Pairs after manual decisions (``status`` confirmed, rejected, unmatched): the last of a left node counts.

    A confirmed pair removes all candidates at either end and stands with score 1; a
    rejected pair goes; an unmatched node loses its candidates.
    """
    last = last_wins(overrides, [a], order)
    confirmed = first_confirmed = last_wins(last.filter("status = 'confirmed'"), [b], order)
    gone = last.filter("status = 'rejected'").select(a, b)
    alone = last.filter("status = 'unmatched'").select(a)
    rest = candidates.join(first_confirmed.select(a), a, "left_anti").join(confirmed.select(b), b, "left_anti").join(gone, [a, b], "left_anti").join(alone, a, "left_anti")
    own = confirmed.select(a, b, F.lit(1.0).alias("score"), F.lit("MANUAL").alias("source"))
    return rest.select(a, b, "score", F.lit("AUTO").alias("source")).unionByName(own)


def duplicates(pairs: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Nodes that several confirmed pairs hold, by side."""
    out = None
    for side, node, other in (("a", a, b), ("b", b, a)):
        rows = pairs.groupBy(F.col(node).alias("node")).agg(F.count_distinct(other).alias("n")).filter("n > 1").withColumn("side", F.lit(side))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_state(zones: DataFrame, states: DataFrame, keys: Sequence[str], default: str = "needs_review") -> DataFrame:
    """Zones with their review status."""
    return zones.join(states, list(keys), "left").withColumn("status", F.coalesce("status", F.lit(default)))


def region_of(points: DataFrame, regions: DataFrame, on: Sequence[str], share: float = 0.2, near: float = 25.0) -> DataFrame:
    """The region of each box: the smallest that holds its centre, else the one it overlaps most (a fifth of it at least), else the nearest within reach.

    ``points`` has ``id x0 y0 x1 y1``, ``regions`` has ``region_id rx0 ry0 rx1 ry1``, both ``on``.
    """
    c = F.col
    pairs = points.join(regions, list(on))
    cx, cy = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    inside = cx.between(c("rx0"), c("rx1")) & cy.between(c("ry0"), c("ry1"))
    overlap = F.greatest(F.least(c("x1"), c("rx1")) - F.greatest(c("x0"), c("rx0")), F.lit(0.0)) * F.greatest(F.least(c("y1"), c("ry1")) - F.greatest(c("y0"), c("ry0")), F.lit(0.0))
    own = (c("x1") - c("x0")) * (c("y1") - c("y0"))
    part = F.when(own > 0, overlap / own).otherwise(0.0)
    dx, dy = F.greatest(c("rx0") - cx, cx - c("rx1"), F.lit(0.0)), F.greatest(c("ry0") - cy, cy - c("ry1"), F.lit(0.0))
    gap = F.sqrt(dx * dx + dy * dy)
    rw, rh = c("rx1") - c("rx0"), c("ry1") - c("ry0")
    reach = F.greatest(F.lit(near), 0.02 * F.sqrt(rw * rw + rh * rh))
    tier = F.when(inside, 1).when(part >= share, 2).when(gap <= reach, 3)
    key = F.when(inside, rw * rh).when(part >= share, -part).otherwise(gap)
    rows = pairs.withColumn("tier", tier).withColumn("_k", key).filter("tier IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("tier", "_k", "region_id"))
    return rows.withColumn("_r", rank).filter("_r = 1").select("id", "region_id", "tier")


def checked_overrides(overrides: DataFrame, files: DataFrame, a: str = "a_path", b: str = "b_path") -> DataFrame:
    """Manual file decisions with an ``error`` for rows that cannot be applied, null for those that can.

    ``overrides`` has the two paths, ``status`` and ``ordinal``; ``files`` has ``path`` and
    ``kind``. Rows apply in order: of confirmed rows that share a file, the first holds and
    the later ones are errors.
    """
    known = lambda c, k: files.select(F.col("path").alias(c), F.col("kind").alias(k))
    rows = overrides.join(known(a, "_ka"), a, "left").join(known(b, "_kb"), b, "left")
    base = (
        F.when(~F.col("status").isin("confirmed", "rejected"), "unknown status").when(F.col("_ka").isNull() | F.col("_kb").isNull(), "missing path")
        .when(F.col("_ka") != F.col("_kb"), "incompatible kinds")
    )
    rows = rows.withColumn("_base", base).withColumn("_c", F.col("_base").isNull() & (F.col("status") == "confirmed"))
    for end in (a, b):
        before = Window.partitionBy(end, "_c").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
        other = b if end == a else a
        rows = rows.withColumn(f"_x{end}", F.col("_c") & F.coalesce(F.first(other).over(before) != F.col(other), F.lit(False)))
    error = F.coalesce(F.col("_base"), F.when(F.col(f"_x{a}") | F.col(f"_x{b}"), "conflicting pair"))
    return rows.withColumn("error", error).drop("_ka", "_kb", "_base", "_c", f"_x{a}", f"_x{b}")


def best_page(drawings: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """The page for each drawing: the only page there is, else the best scored, else page 0 as a fallback.

    ``pages`` has ``set_id page``, ``drawings`` has ``id set_id``, ``scores`` has ``id page score``.
    The first page of each score is found before the shuffle, so that equal scores don't move.
    """
    only = pages.groupBy("set_id").agg(F.count("*").alias("n"), F.min("page").alias("only"))
    first = scores.groupBy("id", "score").agg(F.min("page").alias("page"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))
    best = first.withColumn("_r", rank).filter("_r = 1").select("id", F.col("page").alias("best"))
    rows = drawings.join(only, "set_id", "left").join(best, "id", "left")
    page = F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("best", F.lit(0)))
    source = F.when(F.col("n") == 1, "single").when(F.col("best").isNotNull(), "matched").otherwise("fallback")
    return rows.select("id", page.alias("page"), source.alias("source"))
