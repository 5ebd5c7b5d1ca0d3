"""Geometry as column expressions: boxes are structs of x0, y0, x1, y1; transforms are structs of dx, dy, angle (degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with ordered corners; coordinates that are missing or not finite count as 0."""
    safe = [F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v.cast("double")) for v in (x0, y0, x1, y1)]
    return F.struct(F.least(safe[0], safe[2]).alias("x0"), F.least(safe[1], safe[3]).alias("y0"), F.greatest(safe[0], safe[2]).alias("x1"), F.greatest(safe[1], safe[3]).alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def diagonal(b: Column) -> Column:
    return F.sqrt(width(b) * width(b) + height(b) * height(b))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def box_gap(a: Column, b: Column) -> Column:
    """Distance between two boxes; 0 when they meet."""
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0.0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def overlap_area(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 1 for equal boxes without area."""
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).when(a == b, 1.0).otherwise(0.0)


def ratio_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger; 0.5 if one is missing or not positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.5)


def box_similarity(a: Column, b: Column) -> Column:
    """Mean closeness of widths and heights."""
    return (ratio_similarity(width(a), width(b)) + ratio_similarity(height(a), height(b))) / 2


def size_similarity(aw: Column, ah: Column, bw: Column, bh: Column) -> Column:
    """Closeness of areas; 0.5 if a side is missing."""
    ratio = (aw * ah) / (bw * bh)
    known = (aw > 0) & (ah > 0) & (bw > 0) & (bh > 0)
    return F.when(known & (aw == bw) & (ah == bh), 1.0).when(known, F.least(ratio, 1 / ratio)).otherwise(0.5)


def distance_score(d: Column, radius: Column | float) -> Column:
    return F.greatest(1 - d / radius, F.lit(0.0))


def angle_delta(a: Column, b: Column) -> Column:
    """Shortest arc between two angles, degrees."""
    d = F.abs(F.pmod(a - b, F.lit(360.0)))
    return F.least(d, 360 - d)


def quantised(v: Column, quantum: float) -> Column:
    """The nearest multiple, halves to even; missing and negative zero become 0."""
    q = F.rint(v / quantum) * quantum
    return F.when(v.isNull() | F.isnan(v) | (q == 0), 0.0).otherwise(q)


def steps(v: Column, quantum: float) -> Column:
    """The same as a whole number of quanta, which compares exactly."""
    return F.when(v.isNull() | F.isnan(v), 0).otherwise(F.rint(v / quantum).cast("long"))


def rotated(x: Column, y: Column, t: Column) -> Column:
    """A point under a rigid transform."""
    c, s = F.cos(F.radians(t["angle"])), F.sin(F.radians(t["angle"]))
    return F.struct((x * c - y * s + t["dx"]).alias("x"), (x * s + y * c + t["dy"]).alias("y"))


def inverse(t: Column) -> Column:
    c, s = F.cos(F.radians(t["angle"])), F.sin(F.radians(t["angle"]))
    return F.struct((-(t["dx"] * c + t["dy"] * s)).alias("dx"), (t["dx"] * s - t["dy"] * c).alias("dy"), (-t["angle"]).alias("angle"))


def composed(first: Column, then: Column) -> Column:
    """The transform that applies ``first`` and then ``then``."""
    p = rotated(first["dx"], first["dy"], then)
    return F.struct(p["x"].alias("dx"), p["y"].alias("dy"), (first["angle"] + then["angle"]).alias("angle"))


def affine(m: Column, x: Column, y: Column) -> Column:
    """A point under a flat row-major 4x4 matrix."""
    return F.struct((F.get(m, 0) * x + F.get(m, 1) * y + F.get(m, 3)).alias("x"), (F.get(m, 4) * x + F.get(m, 5) * y + F.get(m, 7)).alias("y"))


def affine_box(m: Column, b: Column) -> Column:
    """The box around the four moved corners."""
    corners = [affine(m, b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    return F.struct(F.least(*[c["x"] for c in corners]).alias("x0"), F.least(*[c["y"] for c in corners]).alias("y0"), F.greatest(*[c["x"] for c in corners]).alias("x1"), F.greatest(*[c["y"] for c in corners]).alias("y1"))


def fit_to_pixels(world: Column, pixels_wide: Column, pixels_high: Column, padding: float = 0.0) -> Column:
    """Scale and offsets that put a world box into a pixel canvas, y downwards."""
    scale = F.least((pixels_wide - 2 * padding) / F.nullif(width(world), F.lit(0.0)), (pixels_high - 2 * padding) / F.nullif(height(world), F.lit(0.0)))
    scale = F.coalesce(scale, F.lit(1.0))
    return F.struct(scale.alias("scale"), (F.lit(padding) - world["x0"] * scale).alias("ox"), (pixels_high - padding + world["y0"] * scale).alias("oy"))


def to_pixel(fit: Column, x: Column, y: Column) -> Column:
    return F.struct((x * fit["scale"] + fit["ox"]).alias("x"), (fit["oy"] - y * fit["scale"]).alias("y"))


def points_to_pixels(b: Column, dpi: float) -> Column:
    """A box in 1/72 inch as pixels."""
    f = dpi / 72.0
    return F.struct((b["x0"] * f).alias("x0"), (b["y0"] * f).alias("y0"), (b["x1"] * f).alias("x1"), (b["y1"] * f).alias("y1"))


def anchored(b: Column, x: Column, y: Column) -> Column:
    """The box moved so that its centre is the place, if it lies farther from it than its diagonal and 1."""
    c = centre(b)
    dx, dy = x - c["x"], y - c["y"]
    far = F.sqrt(dx * dx + dy * dy) > diagonal(b) + 1
    moved = F.struct((b["x0"] + dx).alias("x0"), (b["y0"] + dy).alias("y0"), (b["x1"] + dx).alias("x1"), (b["y1"] + dy).alias("y1"))
    return F.when(far, moved).otherwise(b)


def cloud_chords(b: Column, chord: float) -> Column:
    """How many arcs a revision cloud around the box has: one for each chord of its outline, 8 at least."""
    return F.greatest(F.lit(8), F.ceil(2 * (width(b) + height(b)) / chord).cast("int"))


def arbitrary_axis(nx: Column, ny: Column, nz: Column, x: Column, y: Column, z: Column) -> Column:
    """A point of an object coordinate system (given by its extrusion) in world coordinates."""
    n = F.sqrt(nx * nx + ny * ny + nz * nz)
    n = F.when(n > 0, n).otherwise(1.0)
    nx, ny, nz = nx / n, ny / n, nz / n
    near = (F.abs(nx) < 1 / 64) & (F.abs(ny) < 1 / 64)
    ax, ay, az = F.when(near, nz).otherwise(-ny), F.when(near, 0.0).otherwise(nx), F.when(near, -nx).otherwise(0.0)
    m = F.sqrt(ax * ax + ay * ay + az * az)
    m = F.when(m > 0, m).otherwise(1.0)
    ax, ay, az = ax / m, ay / m, az / m
    bx, by, bz = ny * az - nz * ay, nz * ax - nx * az, nx * ay - ny * ax
    return F.struct((x * ax + y * bx + z * nx).alias("x"), (x * ay + y * by + z * ny).alias("y"), (x * az + y * bz + z * nz).alias("z"))


def path_length(points: Column, closed: Column | bool = False) -> Column:
    """Length of a polyline given as an array of structs with x and y."""
    n = F.size(points)
    legs = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when(i < n, distance(F.get(points, i - 1)["x"], F.get(points, i - 1)["y"], F.get(points, i)["x"], F.get(points, i)["y"]))
        .when(F.lit(closed) & (n > 1), distance(F.get(points, n - 1)["x"], F.get(points, n - 1)["y"], F.get(points, 0)["x"], F.get(points, 0)["y"]))
        .otherwise(0.0),
    )
    return F.aggregate(legs, F.lit(0.0), lambda a, v: a + v)


def without_repeats(points: Column, tolerance: float) -> Column:
    """Vertices farther than the tolerance from the one kept before them."""
    kept = F.aggregate(
        points,
        F.slice(points, 1, 0),
        lambda acc, p: F.when(
            (F.size(acc) == 0) | (distance(F.element_at(F.when(F.size(acc) == 0, points).otherwise(acc), -1)["x"], F.element_at(F.when(F.size(acc) == 0, points).otherwise(acc), -1)["y"], p["x"], p["y"]) > tolerance),
            F.concat(acc, F.array(p)),
        ).otherwise(acc),
    )
    return kept


def least_rotation(items: Column) -> Column:
    """The lexicographically least rotation of a closed sequence, of it and of its reverse."""
    turns = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.concat(F.slice(a, i + 1, F.size(a)), F.slice(a, 1, i)))
    return F.when(F.size(items) == 0, items).otherwise(F.array_min(F.concat(turns(items), turns(F.reverse(items)))))


def ellipse_points(cx: Column, cy: Column, rx: Column, ry: Column, turn: Column, count: int) -> Column:
    """An ellipse as a closed polyline of ``count`` segments."""
    a = F.radians(turn)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count)),
        lambda i: F.struct(
            (cx + rx * F.cos(i * (2 * 3.141592653589793 / count)) * F.cos(a) - ry * F.sin(i * (2 * 3.141592653589793 / count)) * F.sin(a)).alias("x"),
            (cy + rx * F.cos(i * (2 * 3.141592653589793 / count)) * F.sin(a) + ry * F.sin(i * (2 * 3.141592653589793 / count)) * F.cos(a)).alias("y"),
        ),
    )
