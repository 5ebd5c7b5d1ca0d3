"""What differs between two shapes of one kind, and small changes of a shape: rounding, moving, filtering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.geometry import angle_delta, distance, quantised

FIELD = "array<struct<path:string,category:string,delta:double>>"


@dataclass(frozen=True)
class ShapeTolerance:
    """Tolerances of places, numbers and angles (fixed values)."""

    position: float = 1.0
    number: float = 1e-6
    angle: float = 0.001
    case_sensitive: bool = True


def _field(test: Column, path: str | Column, category: str = "geometry", delta: Column | None = None) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    value = F.lit(None).cast("double") if delta is None else F.round(delta, 6)
    return F.when(F.coalesce(test, F.lit(False)), F.struct(path.alias("path"), F.lit(category).alias("category"), value.alias("delta")))


def _place(path: str, a: tuple[Column, Column], b: tuple[Column, Column], most: float) -> Column:
    """A difference if the places are farther apart; a missing place is infinitely far, but two missing ones too."""
    d = distance(*a, *b)
    return _field(d.isNull() | (d > most), path, delta=d)


def _number(path: str | Column, a: Column, b: Column, most: float, between=lambda a, b: F.abs(b - a)) -> Column:
    one = a.isNull() != b.isNull()
    return _field(one | (between(a, b) > most), path, delta=between(a, b))


def shape_diffs(kind: Column, a: Mapping[str, Column], b: Mapping[str, Column], t: ShapeTolerance = ShapeTolerance()) -> Column:
    """Differing fields of two entities of one kind: structs of ``path``, ``category``, ``delta``.

    Both have ``x y x2 y2 radius nx ny nz angle angle2 height text name sx sy closed vertices
    attributes shape`` (a place is ``x y``; vertices have x, y, bulge; attributes have tag, text;
    ``shape`` is a hash of the geometry, which is all that other kinds are compared by).
    """
    at = lambda e, k="": (e[f"x{k}"], e[f"y{k}"])
    angle = lambda path, k: _number(path, a[k], b[k], t.angle, angle_delta)
    main = lambda path: _place(path, at(a), at(b), t.position)

    turned = distance(*at(a), *at(b, "2")) + distance(*at(a, "2"), *at(b)) < distance(*at(a), *at(b)) + distance(*at(a, "2"), *at(b, "2"))
    swap = lambda one, two: tuple(F.when(turned, y).otherwise(x) for x, y in zip(one, two, strict=True))
    line = [_place("geometry.start", at(a), swap(at(b), at(b, "2")), t.position), _place("geometry.end", at(a, "2"), swap(at(b, "2"), at(b)), t.position)]

    off = F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in ("nx", "ny", "nz")), F.lit(0.0)))
    normal = a["nx"].isNotNull() | b["nx"].isNotNull()
    circle = [main("geometry.center"), _number("geometry.radius", a["radius"], b["radius"], t.number), _field(normal & (off.isNull() | (off > t.number)), "geometry.normal", delta=off)]
    arc = [*circle, angle("geometry.start_angle_deg", "angle"), angle("geometry.end_angle_deg", "angle2")]

    same_text = a["text"].eqNullSafe(b["text"]) if t.case_sensitive else F.lower(a["text"]).eqNullSafe(F.lower(b["text"]))
    text = [main("geometry.insert"), _number("geometry.height", a["height"], b["height"], t.number), angle("geometry.rotation_deg", "angle"), _field(~same_text, "geometry.canonical_text", "text")]

    scale = distance(a["sx"], a["sy"], b["sx"], b["sy"])
    tags = lambda e: F.array_sort(F.transform(F.coalesce(e["attributes"], F.array().cast("array<struct<tag:string,text:string>>")), lambda x: F.concat_ws("\x1f", F.coalesce(x["tag"], F.lit("")), F.coalesce(x["text"], F.lit("")))))
    block = [
        _field(~a["name"].eqNullSafe(b["name"]), "geometry.block_name", "block"), main("geometry.insert"), _field(scale.isNull() | (scale > t.number), "geometry.scale", delta=scale),
        angle("geometry.rotation_deg", "angle"), _field(tags(a) != tags(b), "geometry.attributes", "text"),
    ]

    none = F.array().cast("array<struct<x:double,y:double,bulge:double>>")
    va, vb = F.coalesce(a["vertices"], none), F.coalesce(b["vertices"], none)
    closed = lambda e: F.coalesce(e["closed"], F.lit(False))
    n = F.least(F.size(va), F.size(vb))

    def legs(pair: Column, i: Column) -> Column:
        p, q = pair["p"], pair["q"]
        path = lambda name: F.concat(F.lit("geometry.vertices["), i.cast("string"), F.lit(f"].{name}"))
        d = distance(p["x"], p["y"], q["x"], q["y"])
        return F.array_compact(F.array(_field(d.isNull() | (d > t.position), path("point"), delta=d), _number(path("bulge"), p["bulge"], q["bulge"], t.number)))

    pairs = F.transform(F.arrays_zip(F.slice(va, 1, n).alias("p"), F.slice(vb, 1, n).alias("q")), legs)
    outline = F.concat(F.array_compact(F.array(_field(closed(a) != closed(b), "geometry.closed"), _field(F.size(va) != F.size(vb), "geometry.vertex_count", delta=(F.size(vb) - F.size(va)).cast("double")))), F.flatten(pairs))

    of = lambda fields: F.array_compact(F.array(*fields))
    found = (
        F.when(kind == "line", of(line)).when(kind == "circle", of(circle)).when(kind == "arc", of(arc)).when(kind == "polyline", outline).when(kind.isin("text", "mtext"), of(text))
        .when(kind == "block_reference", of(block)).otherwise(of([_field(~a["shape"].eqNullSafe(b["shape"]), "geometry.hash")]))
    )
    return found.cast(FIELD)


def shape_categories(diffs: Column) -> Column:
    """Distinct categories of the differing fields, sorted."""
    return F.array_sort(F.array_distinct(F.transform(diffs, lambda x: x["category"])))


#: Quanta of coordinates, angles and scales, and the fields that are angles or scales (fixed values).
COORDINATE, ANGLE, SCALE = 0.01, 0.001, 1e-6
SCALE_FIELDS = {"scale", "scale_x", "scale_y", "scale_z", "sx", "sy", "sz", "ratio", "minor_to_major_ratio", "start_param", "end_param"}


def field_quantum(name: str) -> float:
    """The quantum of a numeric field by its name."""
    return ANGLE if "angle" in name or name == "rotation_deg" else SCALE if name in SCALE_FIELDS else COORDINATE


def rounded(value: Column, kind: T.DataType, name: str = "") -> Column:
    """Every floating number in a value, however deep in structs and arrays, at the quantum of its field's name."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[rounded(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rounded(x, kind.elementType, name))
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(value.isNotNull(), quantised(value, field_quantum(name)))
    return value


def moved(kind: Column, e: Mapping[str, Column], dx: Column, dy: Column) -> dict[str, Column]:
    """An entity's places moved: its own, a line's other end, and vertices."""
    second = kind == "line"
    out = {"x": e["x"] + dx, "y": e["y"] + dy, "x2": F.when(second, e["x2"] + dx).otherwise(e["x2"]), "y2": F.when(second, e["y2"] + dy).otherwise(e["y2"])}
    if "vertices" in e:
        out["vertices"] = F.transform(e["vertices"], lambda p: p.withField("x", p["x"] + dx).withField("y", p["y"] + dy))
    return out


def layer_kept(layer_id: Column, layer_name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether an entity's layer, by id or name in any case, is asked for (or nothing is) and not left out."""
    keys = [F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (layer_id, layer_name)]
    among = lambda names: keys[0].isin(*names) | keys[1].isin(*names)
    asked, out = ([x.strip().casefold() for x in names if x.strip()] for names in (include, exclude))
    return (among(asked) if asked else F.lit(True)) & (~among(out) if out else F.lit(True))


def in_block_space(old_space: Column, new_space: Column, noted: Column) -> Column:
    """Whether a change is one of a block's definition, whose places are the block's own."""
    return F.coalesce(F.lower(new_space) == "block", F.lit(False)) | F.coalesce(F.lower(old_space) == "block", F.lit(False)) | F.coalesce(F.lower(noted) == "block", F.lit(False))


def annotation_key(kind: Column, e: Mapping[str, Column]) -> Column:
    """The key by which equal entities of the kinds beside lines, curves and texts pair; null for those.

    ``e`` has ``x y x2 y2 angle angle2 ratio measurement text tag name scale paths degree closed
    vertices``. Hatches and solids count by their corners in any order, leaders and splines by theirs in order.
    """
    tenth = lambda v: F.round(F.coalesce(v, F.lit(0.0)), 1)
    place = [tenth(e["x"]), tenth(e["y"])]
    corners = F.transform(F.coalesce(e["vertices"], F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.concat_ws(",", F.round(p["x"], 2), F.round(p["y"], 2)))
    anyhow, inorder = F.array_join(F.array_sort(corners), ";"), F.array_join(corners, ";")
    trimmed = lambda v: F.trim(F.coalesce(v, F.lit("")))
    forms = {
        "dimension": [*place, tenth(e["measurement"]), F.coalesce(e["text"], F.lit(""))], "attrib": [trimmed(e["tag"]), *place], "attdef": [trimmed(e["tag"]), *place],
        "hatch": [F.upper(trimmed(e["name"])), F.round(F.coalesce(e["scale"], F.lit(1.0)), 2), F.round(F.pmod(F.coalesce(e["angle"], F.lit(0.0)), F.lit(360.0)), 1), F.coalesce(e["paths"], F.lit(0)), anyhow],
        "solid": [anyhow], "mleader": [F.round(e["x"], 2), F.round(e["y"], 2), F.coalesce(e["text"], F.lit(""))], "leader": [inorder],
        "spline": [F.coalesce(e["degree"], F.lit(3)), F.coalesce(e["closed"], F.lit(False)), inorder],
        "ellipse": [F.round(v, 2) for v in (e["x"], e["y"], e["x2"], e["y2"])] + [F.round(e["ratio"], 2), F.round(e["angle"], 3), F.round(e["angle2"], 3)],
    }
    out = F.lit(None).cast("string")
    for name, parts in forms.items():
        out = F.when(kind == name, F.md5(F.concat_ws("|", F.lit(name), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]).cast("binary"))).otherwise(out)
    return out


#: Attributes of looks alone (fixed values).
COSMETIC = ("color", "lineweight", "linetype")


def cosmetic_changes(a: Mapping[str, Column], b: Mapping[str, Column], names: Sequence[str] = COSMETIC) -> Column:
    """Which attributes of looks differ, as ``name: old → new`` joined by ``; `` (empty without any)."""
    show = lambda v: F.coalesce(v.cast("string"), F.lit("None"))
    parts = [F.when(~a[n].eqNullSafe(b[n]), F.concat(F.lit(f"{n}: "), show(a[n]), F.lit(" → "), show(b[n]))) for n in names]
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def sheet_alignment(a: Column, b: Column, exact: float = 0.02, most: float = 0.08) -> Column:
    """How two sheets' frames (boxes) fit: struct of ``quality`` (exact, estimated, or null if they don't) and ``mismatch`` of their aspects."""
    aspect = lambda f: (f["x1"] - f["x0"]) / F.nullif(f["y1"] - f["y0"], F.lit(0.0))
    off = F.abs(aspect(a) - aspect(b)) / F.greatest(aspect(b), F.lit(1e-9))
    usable = (a["x1"] > a["x0"]) & (a["y1"] > a["y0"]) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    return F.struct(F.when(usable & (off <= exact), "exact").when(usable & (off <= most), "estimated").alias("quality"), F.when(usable, off).alias("mismatch"))


def page_alignment(frame: Column, wide: Column, high: Column, exact: float = 0.02) -> Column:
    """How a drawing's frame fits a page of pixels: struct of ``quality`` (exact, estimated, relative_only) and ``mismatch`` of the aspects."""
    w, h = frame["x1"] - frame["x0"], frame["y1"] - frame["y0"]
    usable = (w > 0) & (h > 0) & (wide > 0) & (high > 0)
    page = wide / F.nullif(high.cast("double"), F.lit(0.0))
    off = F.abs(w / F.nullif(h, F.lit(0.0)) - page) / F.nullif(page, F.lit(0.0))
    return F.struct(F.when(~F.coalesce(usable, F.lit(False)), "relative_only").when(off <= exact, "exact").otherwise("estimated").alias("quality"), F.when(usable, off).alias("mismatch"))


def frame_box(side: Column, local: Column) -> Column:
    """A box given in shares of a frame, in the frame's own coordinates."""
    w, h = side["x1"] - side["x0"], side["y1"] - side["y0"]
    return F.struct((side["x0"] + local["x0"] * w).alias("x0"), (side["y0"] + local["y0"] * h).alias("y0"), (side["x0"] + local["x1"] * w).alias("x1"), (side["y0"] + local["y1"] * h).alias("y1"))


def in_frame(side: Column, box: Column) -> Column:
    """A box as shares of a frame."""
    w, h = F.greatest(side["x1"] - side["x0"], F.lit(1e-9)), F.greatest(side["y1"] - side["y0"], F.lit(1e-9))
    return F.struct(((box["x0"] - side["x0"]) / w).alias("x0"), ((box["y0"] - side["y0"]) / h).alias("y0"), ((box["x1"] - side["x0"]) / w).alias("x1"), ((box["y1"] - side["y0"]) / h).alias("y1"))
