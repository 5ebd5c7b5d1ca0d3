"""Whole comparisons of two revisions of records, as one plan each.

Records have ``id kind layer x y shape style text`` (``shape`` a geometry hash without the
text). Both engines behind the interface differ by design: the canonical one scores
candidates and calls style-only differences unchanged, the legacy one pairs leftovers by
distance alone and reports cosmetic changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import geometry as g
from driftline.functions.text import is_structural
from driftline.operators.assign import greedy, optimal
from driftline.operators.spatial import near_points
from driftline.operators.tablediff import numbered


class Comparator(Protocol):
    """What a comparison offers: changes of a new revision against an old one."""

    def compare(self, old: DataFrame, new: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Tolerances:
    """Fixed values of the reference; ``preset`` gives the others."""

    radius: float = 5.0
    threshold: float = 0.62
    position: float = 1.0
    structural: float = 0.1
    text_radius: float = 50.0
    same_layer: float = 1.0
    other_layer: float = 0.35

    @classmethod
    def preset(cls, name: str) -> Tolerances:
        scale = {"strict": 0.5, "normal": 1.0, "relaxed": 2.0}[name]
        return cls(position=cls.position * scale, structural=cls.structural * scale)


#: Kinds that are matched within the text radius.
TEXT_LIKE = ("TEXT", "MTEXT", "ATTRIB", "ATTDEF", "DIMENSION")


def exact_pairs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Equal records paired by occurrence."""
    a = numbered(old.select(*keys, F.col("id").alias("a_id")), keys, ["a_id"])
    b = numbered(new.select(*keys, F.col("id").alias("b_id")), keys, ["b_id"])
    return a.join(b, [*keys, "occurrence"]).select("a_id", "b_id")


def _rest(side: DataFrame, pairs: DataFrame, end: str) -> DataFrame:
    return side.join(pairs.select(F.col(end).alias("id")), "id", "left_anti")


def box_score(a: Column, b: Column, t: Tolerances) -> Column:
    """The better of two boxes' overlap and nearness."""
    return F.greatest(g.iou(a, b), g.distance_score(g.box_gap(a, b), t.radius))


def pair_score(kind_same: Column, layer_same: Column, distance: Column, shape_same: Column, t: Tolerances, box: Column | None = None) -> Column:
    """.25 kind, .15 layer, .20 box, .20 centre by distance, .20 geometry; a quarter of it for different kinds.

    Without a box score the records are points, whose boxes are as near as their centres.
    """
    near = g.distance_score(distance, t.radius)
    layer = F.when(layer_same, t.same_layer).otherwise(t.other_layer)
    score = F.when(kind_same, 0.25).otherwise(0.0) + 0.15 * layer + 0.20 * (near if box is None else box) + 0.20 * near + F.when(shape_same, 0.20).otherwise(0.0)
    return F.when(kind_same, score).otherwise(score * 0.25)


@dataclass(frozen=True)
class Canonical:
    """Exact pairs, then scored candidates walked greedily, then the differences of each pair."""

    tolerances: Tolerances = Tolerances()

    def compare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        t = self.tolerances
        exact = exact_pairs(old, new, ["kind", "layer", "shape", "x", "y"])
        a, b = _rest(old, exact, "a_id"), _rest(new, exact, "b_id")
        near = near_points(a.select("id", "kind", "x", "y", "layer", "shape"), b.select("id", "kind", "x", "y", "layer", "shape"), t.radius, t.radius, ["kind"])
        score = pair_score(F.lit(True), F.col("a_layer") == F.col("b_layer"), F.col("distance"), F.col("a_shape") == F.col("b_shape"), t)
        edges = near.withColumn("score", score).filter(F.col("score") >= t.threshold).select("a_id", "b_id", "score", "distance")
        pairs = greedy(edges, [F.desc("score"), F.col("distance"), F.col("a_id"), F.col("b_id")]).select("a_id", "b_id")
        return differences(old, new, exact.unionByName(pairs), t, removed="removed", style_is_change=False)


@dataclass(frozen=True)
class Legacy:
    """Multiset pairs by shape and place, then leftovers of one kind and layer by an optimal assignment within a radius."""

    tolerances: Tolerances = Tolerances()

    def compare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        t = self.tolerances
        exact = exact_pairs(old, new, ["kind", "layer", "shape", "x", "y"])
        a, b = _rest(old, exact, "a_id").select("id", "kind", "layer", "x", "y"), _rest(new, exact, "b_id").select("id", "kind", "layer", "x", "y")
        on = ["kind", "layer"]
        text = F.col("kind").isin(*TEXT_LIKE)
        edges = near_points(a.filter(~text), b.filter(~text), t.radius, t.radius, on).unionByName(near_points(a.filter(text), b.filter(text), t.text_radius, t.text_radius, on))
        pairs = optimal(edges.select("a_id", "b_id", "distance"), "distance").select("a_id", "b_id")
        return differences(old, new, exact.unionByName(pairs), t, removed="deleted", style_is_change=True)


def differences(old: DataFrame, new: DataFrame, pairs: DataFrame, t: Tolerances, removed: str, style_is_change: bool) -> DataFrame:
    """One row per record of either side: its kind of change and the paths that differ."""
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.struct("kind", "layer", "x", "y", "shape", "style", "text").alias(s))
    both = pairs.join(side(old, "a"), "a_id").join(side(new, "b"), "b_id")
    gone = _rest(old, pairs, "a_id").select(F.col("id").alias("a_id"), F.lit(None).cast("long").alias("b_id"), "kind", "layer", F.lit(removed).alias("change_type"), F.lit("").alias("paths"))
    come = _rest(new, pairs, "b_id").select(F.lit(None).cast("long").alias("a_id"), F.col("id").alias("b_id"), "kind", "layer", F.lit("added").alias("change_type"), F.lit("").alias("paths"))
    limit = F.when(is_structural(F.col("a.layer")), t.structural).otherwise(t.position)
    moved = g.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) > limit
    checks = {"position": moved, "geometry": F.col("a.shape") != F.col("b.shape"), "text": ~F.col("a.text").eqNullSafe(F.col("b.text")), "layer": F.col("a.layer") != F.col("b.layer")}
    if style_is_change:
        checks["style"] = ~F.col("a.style").eqNullSafe(F.col("b.style"))
    paths = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])), ",")
    matched = both.select("a_id", "b_id", "a.kind", "a.layer", F.when(paths == "", "unchanged").otherwise("modified").alias("change_type"), paths.alias("paths"))
    return matched.unionByName(gone).unionByName(come)
