"""Channels of a comparison beside its matching: looks, attribute contents, modified records, and origins that moved."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import changes as ch
from driftline.functions import geometry as g
from driftline.functions.shapes import COSMETIC, cosmetic_changes
from driftline.operators.alignment import upper_median_shift
from driftline.operators.assign import greedy
from driftline.operators.spatial import near_points
from driftline.plans.scratch import Scratch


def _side(s: str, names: Sequence[str]) -> dict[str, Column]:
    return {n: F.col(f"{s}_{n}") for n in names}


def cosmetic(pairs: DataFrame, names: Sequence[str] = COSMETIC) -> DataFrame:
    """Pairs (with ``a_`` and ``b_`` attributes) whose looks differ, with the ``detail`` of what does."""
    detail = cosmetic_changes(_side("a", names), _side("b", names), names)
    return pairs.withColumn("detail", detail).filter("detail <> ''").withColumn("change_category", F.lit("cosmetic"))


def without_cosmetic(changes: DataFrame) -> DataFrame:
    """Changes but for modified records of looks alone."""
    return changes.filter(~((F.lower("change_type") == "modified") & F.coalesce(F.col("change_category") == "cosmetic", F.lit(False))))


def matched_contents(pairs: DataFrame, s: ch.Sensitivity = ch.Sensitivity()) -> DataFrame:
    """Pairs of attributes that matched by tag and place but whose contents differ, as modified changes."""
    rows = pairs.filter(F.col("kind").isin("ATTRIB", "ATTDEF") & ~F.col("a_text").eqNullSafe(F.col("b_text")))
    return modified(rows, s)


def modified(pairs: DataFrame, s: ch.Sensitivity = ch.Sensitivity()) -> DataFrame:
    """Matched pairs as modified changes: categories, difference of measures, and the move; without insignificant ones.

    ``pairs`` has ``a_id b_id kind layer`` and of each side ``x y measure rotation scale text``.
    """
    names = ("x", "y", "measure", "rotation", "scale", "text")
    a, b = _side("a", names), _side("b", names)
    move = g.distance(a["x"], a["y"], b["x"], b["y"])
    old, new = ({"measure": e["measure"], "rotation": e["rotation"], "scale": e["scale"], "content": e["text"]} for e in (a, b))
    rows = pairs.withColumn("_c", ch.categories(s, F.col("kind"), F.col("layer"), move, old, new)).withColumn("moved", move)
    rows = rows.filter(ch.significant(F.col("_c"), F.col("moved"), s.position_limit(F.col("layer"))))
    return rows.select("a_id", "b_id", "kind", "layer", F.lit("modified").alias("change_type"), F.array_join("_c", ",").alias("change_category"), F.when(F.col("kind") == "DIMENSION", F.col("b_measure") - F.col("a_measure")).alias("measurement_diff"), "moved")


def same_when_registered(kind: Column, a: Mapping[str, Column], b: Mapping[str, Column], dx: Column, dy: Column, tolerance: Column) -> Column:
    """Whether two records are one, once the second is moved; kinds without a proof are not, unless their own data are equal.

    Both have ``x y x2 y2 radius angle angle2 text name sx sy measure closed vertices data``
    (``data``: everything that a record holds in its own coordinates).
    """
    near = lambda p, q: g.distance(a[p[0]], a[p[1]], b[q[0]] + dx, b[q[1]] + dy) <= tolerance
    one, two = ("x", "y"), ("x2", "y2")
    close = lambda k, most: F.abs(a[k] - b[k]) <= most
    turn = lambda k: g.angle_delta(a[k], b[k]) <= 0.1
    legs = F.zip_with(a["vertices"], b["vertices"], lambda p, q: g.distance(p["x"], p["y"], q["x"] + dx, q["y"] + dy) <= tolerance)
    proofs = {
        "LINE": (near(one, one) & near(two, two)) | (near(one, two) & near(two, one)), "CIRCLE": near(one, one) & close("radius", tolerance),
        "ARC": near(one, one) & close("radius", tolerance) & turn("angle") & turn("angle2"),
        "POLYLINE": (F.size(a["vertices"]) > 0) & (F.size(a["vertices"]) == F.size(b["vertices"])) & a["closed"].eqNullSafe(b["closed"]) & F.forall(legs, lambda ok: ok),
        "TEXT": near(one, one) & a["text"].eqNullSafe(b["text"]), "DIMENSION": near(one, one) & a["text"].eqNullSafe(b["text"]) & close("measure", tolerance),
        "INSERT": near(one, one) & a["name"].eqNullSafe(b["name"]) & close("sx", 1e-3) & close("sy", 1e-3) & turn("angle"),
    }
    proofs |= {"LWPOLYLINE": proofs["POLYLINE"], "MTEXT": proofs["TEXT"]}
    out = F.lit(False)
    for name, proof in proofs.items():
        out = F.when(kind == name, proof).otherwise(out)
    return F.coalesce(a["data"] == b["data"], F.lit(False)) | F.coalesce(out, F.lit(False))


#: Tolerance of the first pass over a moved origin, and the pairs that it takes to fit the move again (fixed values).
COARSE, LEAST_REFIT = 3.0, 4


def reorigin_unchanged(deleted: DataFrame, added: DataFrame, by: Sequence[str], shift: DataFrame, proof: Callable[[Column, Column, Column], Column], tolerance: Callable[[Column], Column]) -> DataFrame:
    """Pairs of deleted and added records that are one record once a group's move is undone.

    Both have ``id kind layer x y`` and what ``proof`` reads (as ``a_`` and ``b_`` columns, with
    the move and the tolerance); ``shift`` has ``by`` and ``dx dy`` that bring added records
    onto deleted ones. A first pass with a fixed tolerance fits the move again by the
    middle of what is left of it; the second pass is by the layer's tolerance.
    """
    scratch = Scratch(deleted.sparkSession, "reorigin")

    def matched(move: DataFrame, most: Callable[[Column], Column], name: str) -> DataFrame:
        came = added.join(F.broadcast(move) if move.count() <= 10_000 else move, list(by))
        moved = came.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy"), "own_x": F.col("x"), "own_y": F.col("y")})
        edges = near_points(deleted.withColumns({"own_x": F.col("x"), "own_y": F.col("y"), "dx": F.lit(0.0), "dy": F.lit(0.0)}), moved, COARSE, COARSE, [*by, "kind", "layer"])
        edges = edges.filter(proof(F.col("b_dx"), F.col("b_dy"), most(F.col("layer"))))
        return scratch.write(greedy(edges.select(*by, "a_id", "b_id", "distance", "a_own_x", "a_own_y", "b_own_x", "b_own_y", "b_dx", "b_dy"), ["distance", "a_id", "b_id"]), name)

    first = matched(shift, lambda layer: F.lit(COARSE), "first")
    left = first.select(*by, (F.col("b_own_x") + F.col("b_dx")).alias("ax"), (F.col("b_own_y") + F.col("b_dy")).alias("ay"), F.col("a_own_x").alias("bx"), F.col("a_own_y").alias("by"))
    enough = first.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_REFIT).select(*by)
    more = upper_median_shift(left.join(enough, list(by)), list(by)).select(*by, F.col("dx").alias("mx"), F.col("dy").alias("my"))
    fine = shift.join(more, list(by), "left").select(*by, (F.col("dx") + F.coalesce("mx", F.lit(0.0))).alias("dx"), (F.col("dy") + F.coalesce("my", F.lit(0.0))).alias("dy"))
    return matched(scratch.write(fine, "fine"), tolerance, "second").select(*by, "a_id", "b_id")


def enough_changes(changes: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """The changes of groups with at least ``least`` of them; a group with fewer counts as unchanged."""
    groups = changes.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(*by)
    return changes.join(groups, list(by), "left_semi")


def layer_report(changes: DataFrame) -> DataFrame:
    """Counts of each layer by kind of change, moves between layers apart, and the priority of its first change (``layer change_type change_category priority id``)."""
    kind = lambda k: F.count_if(F.lower("change_type") == k)
    move = F.count_if((F.lower("change_type") == "modified") & F.coalesce(F.col("change_category") == "layer_move", F.lit(False)))
    return changes.groupBy("layer").agg(kind("added").alias("added"), kind("deleted").alias("deleted"), (kind("modified") - move).alias("modified"), move.alias("layer_moves"), F.min_by("priority", "id").alias("priority"))


def priority_summary(report: DataFrame) -> DataFrame:
    """Changes by the priority of their layers."""
    return report.groupBy("priority").agg(F.sum(F.col("added") + F.col("deleted") + F.col("modified") + F.col("layer_moves")).alias("changes"), F.count("*").alias("layers"))
