"""Two sets of drawing files as changes: read, expanded, matched, compared by shape, grouped into zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import geometry as g
from driftline.functions.shapes import shape_categories, shape_diffs
from driftline.functions.text import mtext, plain
from driftline.operators.assign import greedy
from driftline.operators.spatial import near_points
from driftline.operators.zones import summaries
from driftline.plans.compare import Tolerances, box_score, exact_pairs, pair_score

#: What an entity is compared by.
FIELDS = ("x", "y", "x2", "y2", "radius", "nx", "ny", "nz", "angle", "angle2", "height", "text", "name", "sx", "sy", "closed", "vertices", "attributes", "shape")
_TEXTS = ("text", "mtext", "attrib", "attdef")
#: Decimals of places, and of sizes and angles, in an entity's shape (fixed values).
PLACE, SIZE = 2, 3


def entities(raw: DataFrame, drawing: Column, layout: str = "Model") -> DataFrame:
    """Entities of one layout, a row each: inserts with their attributes, and the entities of their blocks in place.

    ``raw`` is what the reader gives. Places in an object's own axes come to world axes; a
    block's entities take their insert's scale, turn and place, and its layer where their
    own is ``0``; colour and line type by layer come from the layer table.
    """
    from driftline.sources.dxf import layer_table, of_layout

    rows = raw.withColumn("drawing", drawing)
    top = of_layout(rows, layout)
    tags = top.filter("kind = 'attrib'").groupBy("path", F.col("owner").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("name", F.lit("")).alias("tag"), plain(F.col("text")).alias("text")))).alias("attributes"))
    own = top.filter("kind <> 'attrib'").join(tags, ["path", "ordinal"], "left").withColumn("part", F.lit(0).cast("long"))
    inside = rows.filter("status = 'ok' AND space = 'block'").select("path", F.col("block").alias("name"), *[F.col(c).alias(f"c_{c}") for c in ("ordinal", "raw_type", "kind", "layer", "x", "y", "x2", "y2", "radius", "angle", "angle2", "text", "name", "color", "linetype", "closed", "vertices", "sx", "sy", "nx", "ny", "nz")])
    placed = own.filter("kind = 'block_reference'").join(inside, ["path", "name"])
    turn, sx, sy = F.coalesce("angle", F.lit(0.0)), F.coalesce("sx", F.lit(1.0)), F.coalesce("sy", F.lit(1.0))

    def put(x: Column, y: Column) -> Column:
        p = g.rotated(x * sx, y * sy, F.struct(F.col("x").alias("dx"), F.col("y").alias("dy"), turn.alias("angle")))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"))

    one, two = put(F.col("c_x"), F.col("c_y")), put(F.col("c_x2"), F.col("c_y2"))
    size = (F.abs(sx) + F.abs(sy)) / 2
    corner = lambda v: put(v["x"], v["y"]).withField("bulge", F.when(sx * sy < 0, -v["bulge"]).otherwise(v["bulge"]))
    kids = placed.select(
        "path", "drawing", "ordinal", F.col("c_ordinal").alias("part"), F.col("c_raw_type").alias("raw_type"), F.col("c_kind").alias("kind"), F.when(F.col("c_layer") == "0", F.col("layer")).otherwise(F.col("c_layer")).alias("layer"),
        one["x"].alias("x"), one["y"].alias("y"), two["x"].alias("x2"), two["y"].alias("y2"), (F.col("c_radius") * size).alias("radius"), (F.col("c_angle") + turn).alias("angle"), (F.col("c_angle2") + turn).alias("angle2"), F.col("c_text").alias("text"), F.col("c_name").alias("name"),
        F.when(F.lower("c_color") == "byblock", F.col("color")).otherwise(F.col("c_color")).alias("color"), F.col("c_linetype").alias("linetype"), F.col("c_closed").alias("closed"), F.transform("c_vertices", corner).alias("vertices"), (F.col("c_sx") * sx).alias("sx"), (F.col("c_sy") * sy).alias("sy"),
        F.col("c_nx").alias("nx"), F.col("c_ny").alias("ny"), F.col("c_nz").alias("nz"), F.lit(None).cast("array<struct<tag:string,text:string>>").alias("attributes"),
    )
    flat = own.select(*kids.columns).unionByName(kids)
    looks = layer_table(rows).select("path", "layer", F.col("color").alias("_color"), F.col("linetype").alias("_linetype"))
    flat = flat.join(looks, ["path", "layer"], "left")
    by_layer = lambda c: F.when(F.col(c).isNull() | F.upper(F.col(c)).isin("BYLAYER", "256"), F.col(f"_{c}")).otherwise(F.col(c))
    oriented = F.col("nx").isNotNull() & F.col("kind").isin("circle", "arc", "text", "block_reference", "polyline")
    world = g.arbitrary_axis(F.col("nx"), F.col("ny"), F.col("nz"), F.col("x"), F.col("y"), F.lit(0.0))
    flat = flat.withColumns({"x": F.when(oriented, world["x"]).otherwise(F.col("x")), "y": F.when(oriented, world["y"]).otherwise(F.col("y"))})
    text = F.when(F.col("kind") == "mtext", mtext(F.col("text"))).when(F.col("kind").isin(*_TEXTS), plain(F.col("text"))).otherwise(F.col("text"))
    start = F.get("vertices", 0)
    flat = flat.withColumns({"text": text, "x": F.coalesce("x", start["x"]), "y": F.coalesce("y", start["y"]), "color": by_layer("color"), "linetype": by_layer("linetype"), "height": F.when(F.col("kind").isin(*_TEXTS), F.col("radius"))}).drop("_color", "_linetype")
    at = lambda v, d: F.coalesce(F.round(v, d).cast("string"), F.lit("~"))
    line = F.col("kind") == "line"
    ends = [F.struct(F.round(F.col(a), PLACE).alias("x"), F.round(F.col(b), PLACE).alias("y")) for a, b in (("x", "y"), ("x2", "y2"))]
    low, high = F.when(line, F.least(*ends)).otherwise(ends[0]), F.when(line, F.greatest(*ends)).otherwise(ends[1])
    outline = F.array_join(F.transform("vertices", lambda v: F.concat_ws(",", at(v["x"], PLACE), at(v["y"], PLACE), at(v["bulge"], SIZE))), ";")
    shape = [at(p[c], PLACE) for p in (low, high) for c in ("x", "y")] + [at(F.col(c), SIZE) for c in ("radius", "angle", "angle2", "sx", "sy", "nx", "ny", "nz")] + [F.coalesce(c.cast("string"), F.lit("~")) for c in (F.col("name"), F.col("closed"), outline, F.to_json("attributes"))]
    flat = flat.withColumn("shape", F.md5(F.concat_ws("|", "kind", *shape).cast("binary")))
    return flat.withColumn("id", F.xxhash64("path", "ordinal", "part"))


def extent(kind: Column) -> Column:
    """The box of an entity: a line's ends, a circle's or arc's whole circle, a polyline's corners, else its place."""
    x, y, r = F.col("x"), F.col("y"), F.coalesce("radius", F.lit(0.0))
    corners = lambda c: F.transform("vertices", lambda v: v[c])
    line, ring, outline = g.box(x, y, F.col("x2"), F.col("y2")), g.box(x - r, y - r, x + r, y + r), g.box(F.array_min(corners("x")), F.array_min(corners("y")), F.array_max(corners("x")), F.array_max(corners("y")))
    return F.when(kind == "line", line).when(kind.isin("circle", "arc"), ring).when(F.size("vertices") > 0, outline).otherwise(g.box(x, y, x, y))


def changes(old: DataFrame, new: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """Changes between two sets of entities by drawing: one row per entity of either side, with the paths that differ.

    Equal entities pair by occurrence; of the rest, near ones of one kind pair by score, the
    best first. Looks alone make no change.
    """
    exact = exact_pairs(old.withColumn("text", F.coalesce("text", F.lit(""))), new.withColumn("text", F.coalesce("text", F.lit(""))), ["drawing", "kind", "layer", "shape", "text"])
    centred = lambda side: side.withColumn("box", extent(F.col("kind"))).withColumns({"x": g.centre(F.col("box"))["x"], "y": g.centre(F.col("box"))["y"]})
    rest = lambda side, end: centred(side.join(exact.select(F.col(end).alias("id")), "id", "left_anti")).select("id", "drawing", "kind", "layer", "x", "y", "shape", "box")
    near = near_points(rest(old, "a_id"), rest(new, "b_id"), t.radius, t.radius, ["drawing", "kind"])
    score = pair_score(F.lit(True), F.col("a_layer") == F.col("b_layer"), F.col("distance"), F.col("a_shape") == F.col("b_shape"), t, box_score(F.col("a_box"), F.col("b_box"), t))
    edges = near.withColumn("score", score).filter(F.col("score") >= t.threshold).select("a_id", "b_id", "score", "distance")
    pairs = exact.unionByName(greedy(edges, [F.desc("score"), F.col("distance"), F.col("a_id"), F.col("b_id")]).select("a_id", "b_id"))
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.struct("drawing", "raw_type", "kind", "layer", *FIELDS).alias(s))
    both = pairs.join(side(old, "a"), "a_id").join(side(new, "b"), "b_id")
    a, b = ({n: F.col(f"{s}.{n}") for n in FIELDS} for s in "ab")
    fields = F.concat(shape_diffs(F.col("a.kind"), a, b), F.when(F.col("a.layer") != F.col("b.layer"), F.array(F.struct(F.lit("layer").alias("path"), F.lit("layer").alias("category"), F.lit(None).cast("double").alias("delta")))).otherwise(F.array().cast("array<struct<path:string,category:string,delta:double>>")))
    both = both.withColumn("fields", fields)
    columns = lambda s: [F.col(f"{s}.drawing").alias("drawing"), F.col(f"{s}.raw_type").alias("entity_type"), F.col(f"{s}.layer").alias("layer"), F.col(f"{s}.x").alias("x"), F.col(f"{s}.y").alias("y")]
    matched = both.select(*columns("b"), "a_id", "b_id", F.when(F.size("fields") == 0, "unchanged").otherwise("modified").alias("change_type"), F.array_join(F.transform("fields", lambda f: f["path"]), ",").alias("paths"), F.array_join(shape_categories(F.col("fields")), ",").alias("category"))
    none, empty = F.lit(None).cast("long"), F.lit("")
    gone = side(old, "a").join(pairs.select("a_id"), "a_id", "left_anti").select(*columns("a"), "a_id", none.alias("b_id"), F.lit("deleted").alias("change_type"), empty.alias("paths"), empty.alias("category"))
    come = side(new, "b").join(pairs.select("b_id"), "b_id", "left_anti").select(*columns("b"), none.alias("a_id"), "b_id", F.lit("added").alias("change_type"), empty.alias("paths"), empty.alias("category"))
    return matched.unionByName(gone).unionByName(come)


def zone_summary(found: DataFrame, cell: float, by: Sequence[str] = ("drawing",)) -> DataFrame:
    """Severity, type and counts of the changes of each grid cell of a drawing."""
    rows = found.filter("change_type <> 'unchanged'")
    rows = rows.withColumns({"zone_x": F.floor(F.col("x") / cell), "zone_y": F.floor(F.col("y") / cell), "x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    return summaries(rows, [*by, "zone_x", "zone_y"])
