"""Identity keys of entities by kind, predicates over layers and changes, and small geometry of entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.geometry import boxes_meet, contains, least_rotation, steps
from driftline.functions.text import is_title_block, matches_any, plain

QUANTUM, ANGLE_QUANTUM, SCALE_QUANTUM = 0.01, 0.001, 1e-6


def _joined(name: str, parts: Sequence[Column]) -> Column:
    return F.concat_ws("|", F.lit(name), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])


def entity_key(kind: Column, e: Mapping[str, Column]) -> Column:
    """The key by which equal entities pair, one form for each kind; other kinds by their place alone.

    ``e`` has ``x y x2 y2 radius angle angle2 text name sx sy vertices closed``. Lines count
    either way round, closed outlines from any vertex, texts by place and plain content.
    """
    q = lambda c: steps(c, QUANTUM)
    a = lambda c: steps(F.pmod(c, F.lit(360.0)), ANGLE_QUANTUM)
    one, two = F.struct(q(e["x"]).alias("x"), q(e["y"]).alias("y")), F.struct(q(e["x2"]).alias("x"), q(e["y2"]).alias("y"))
    low, high = F.least(one, two), F.greatest(one, two)
    points = F.transform(e["vertices"], lambda p: F.concat_ws(",", q(p["x"]).cast("string"), q(p["y"]).cast("string")))
    outline = F.array_join(F.when(F.coalesce(e["closed"], F.lit(False)), least_rotation(points)).otherwise(points), ";")
    forms = {
        "line": _joined("line", [low["x"], low["y"], high["x"], high["y"]]), "circle": _joined("circle", [q(e["x"]), q(e["y"]), q(e["radius"])]),
        "arc": _joined("arc", [q(e["x"]), q(e["y"]), q(e["radius"]), a(e["angle"]), a(e["angle2"])]), "polyline": _joined("polyline", [outline, F.coalesce(e["closed"], F.lit(False))]),
        "text": _joined("text", [q(e["x"]), q(e["y"]), plain(e["text"])]), "insert": _joined("insert", [e["name"], q(e["x"]), q(e["y"]), steps(e["sx"], SCALE_QUANTUM), steps(e["sy"], SCALE_QUANTUM), a(e["angle"])]),
    }
    out = _joined("other", [kind, q(e["x"]), q(e["y"])])
    for name, form in forms.items():
        out = F.when(kind == name, form).otherwise(out)
    return F.md5(out.cast("binary"))


def local_place(x: Column, y: Column, px: Column, py: Column, sx: Column, sy: Column, angle: Column) -> Column:
    """A place in its parent's own coordinates: the parent's shift, turn and scale undone."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    dx, dy = x - px, y - py
    scale = lambda v: F.when(v == 0, 1.0).otherwise(v)
    return F.struct(((dx * c + dy * s) / scale(sx)).alias("x"), ((dy * c - dx * s) / scale(sy)).alias("y"))


def flattened(points: Column, per_leg: int) -> Column:
    """A curve's fit points with ``per_leg`` straight steps between neighbours (no curve is evaluated)."""
    n = F.size(points)
    legs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(0), F.lit(per_leg - 1)), lambda k: F.struct(
        (F.get(points, i - 1)["x"] + (F.get(points, i)["x"] - F.get(points, i - 1)["x"]) * k / per_leg).alias("x"),
        (F.get(points, i - 1)["y"] + (F.get(points, i)["y"] - F.get(points, i - 1)["y"]) * k / per_leg).alias("y"),
    )))
    last = F.transform(F.slice(points, -1, 1), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.when(n > 1, F.concat(F.flatten(legs), last)).otherwise(last)


def reversed_outline(vertices: Column) -> Column:
    """A closed outline the other way round: its arcs bulge to the other side and belong to the leg before (structs x, y, bulge)."""
    n = F.size(vertices)
    back = F.reverse(vertices)
    return F.transform(back, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), (-F.get(back, F.pmod(i + 1, n).cast("int"))["bulge"]).alias("bulge")))


def layer_priority(layer: Column, groups: Sequence[tuple[int, list[str]]], default: int = 1) -> Column:
    """The priority of the first pattern group that fits (2 critical, 1 ordinary, 0 low, -1 ignored)."""
    out = F.lit(default)
    for value, patterns in reversed(groups):
        out = F.when(matches_any(layer, patterns), value).otherwise(out)
    return out


def change_ignored(layer: Column, layers: list[str], patterns: list[str], title_blocks: bool = True) -> Column:
    """Whether a change's layer is named, fits a pattern, or is a title block's."""
    named = F.upper(F.coalesce(layer, F.lit(""))).isin(*[x.upper() for x in layers]) if layers else F.lit(False)
    return named | matches_any(layer, patterns) | (is_title_block(layer) if title_blocks else F.lit(False))


def in_region(overlay: Column, region: Column, mode: str) -> Column:
    """Whether an overlay lies in a region: ``contained`` in it, or ``intersecting`` it."""
    return contains(region, overlay) if mode == "contained" else boxes_meet(region, overlay)


#: Layers and words of tables and structure on a sheet (fixed values).
TITLE_LAYERS = ["*TITLE*", "*TITLEBLOCK*"]
TABLE_LAYERS = ["*TABLE*", "*SCHEDULE*", "*BOM*", "*BLOCK INFO*", "*BLOCKINFO*"]
TABLE_WORDS = ("BLOCK INFO", "BLOCKINFO", "TITLE", "TITLEBLOCK", "REV", "REVISION", "TABLE", "SCHEDULE", "BOM", "MATERIAL", "DWG", "SHEET", "SCALE", "DATE", "DRAWN", "CHECK", "APPROVED")
STRUCTURE_TOKENS = ("BEAM", "COL", "SLAB", "WALL", "GRID", "REBAR")
OTHER_TOKENS = ("TITLE", "TABLE", "REV", "BOM", "BLOCK INFO")
LINES, SHAPES, TEXTS = ("LINE", "LWPOLYLINE", "POLYLINE"), ("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC", "ELLIPSE"), ("TEXT", "MTEXT", "ATTRIB", "ATTDEF")


def _holds(value: Column, words: Sequence[str]) -> Column:
    up = F.upper(F.coalesce(value, F.lit("")))
    return reduce(lambda x, y: x | y, [F.contains(up, F.lit(w)) for w in words])


def looks_structural(layer: Column, entity: Column) -> Column:
    """Whether an entity is one of structure: no text, on no title or table layer; on a structural layer, or a shape."""
    kind = F.upper(F.coalesce(entity, F.lit("")))
    out = kind.isin(*TEXTS) | is_title_block(layer) | matches_any(layer, TITLE_LAYERS + TABLE_LAYERS) | _holds(layer, OTHER_TOKENS)
    return ~out & (_holds(layer, STRUCTURE_TOKENS) | kind.isin(*SHAPES))


def table_word(layer: Column, text: Column, block: Column) -> Column:
    """Whether an entity names a table: its layer or block is a table's or title's, or a word of tables stands in it."""
    return is_title_block(layer) | matches_any(layer, TITLE_LAYERS + TABLE_LAYERS) | matches_any(block, TABLE_LAYERS) | _holds(F.concat_ws(" ", layer, text, block), TABLE_WORDS)


def table_reasons(n: Column, n_text: Column, n_line: Column, n_structural: Column, named: Column, area: Column, whole_area: Column) -> Column:
    """Why a region is rejected as a table, from counts of its entities; empty if it isn't.

    A table word with a small area, many texts or many rulings rejects it, and so do the three
    without the word; a region that structure dominates is kept.
    """
    part = lambda share: F.floor(n * share)
    small = (whole_area > 0) & (area <= whole_area * 0.08)
    heavy = n_text >= F.greatest(F.lit(4), part(0.35))
    ruled = (n_line >= 6) & (n_structural <= F.greatest(F.lit(2), part(0.20)))
    kept = (n_structural >= F.greatest(F.lit(10), part(0.35))) & ~heavy & ~ruled
    names = F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in (("table keyword", named), ("small relative area", small), ("text heavy", heavy), ("grid-like table", ruled))]))
    rejected = (n > 0) & ~kept & ((named & (small | heavy | ruled)) | (small & heavy & ruled))
    return F.when(rejected, names).otherwise(F.array().cast("array<string>"))


def cascade(first: Column, second: Column, second_confidence: Column, least: float) -> Column:
    """The later stage's answer where it is sure enough, else the earlier one's."""
    return F.when(second.isNotNull() & (second_confidence >= least), second).otherwise(first)


def needs_review(stage: Column, confidence: Column, least: float = 0.6) -> Column:
    """Whether a further stage should look: only a heuristic answered, or it is not sure."""
    return (stage == "heuristic") | (confidence < least)
