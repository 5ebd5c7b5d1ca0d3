"""Shapes, channels and priorities of changes over parts and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import keys, review, shapes
from driftline.functions import geometry as g
from driftline.operators import channels
from driftline.queries.common import table

KINDS = ["line", "circle", "arc", "polyline", "text", "block_reference", "hatch"]


def _pick(values: list, index) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def shape_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of seven kinds against a revision of them."""
    k, s, x = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice")
    num = lambda v: F.lit(float(v))
    vertex = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("bulge"))
    normal = lambda z: {"nx": F.when(k % 3 == 0, 0.0), "ny": F.when(k % 3 == 0, 0.0), "nz": F.when(k % 3 == 0, z)}
    tag = lambda v: F.array(F.struct(F.lit("A").alias("tag"), v.alias("text")))
    old = {
        "x": x, "y": s, "x2": x + 10, "y2": s, "radius": s, **normal(num(1)), "angle": s * 10, "angle2": s * 20, "height": num(2.5), "text": F.col("p_name"), "name": F.col("p_brand"), "sx": num(1), "sy": num(1),
        "closed": k % 2 == 0, "vertices": F.array(vertex(num(0), num(0), num(0)), vertex(s, num(0), num(0.5)), vertex(s, s, num(0))), "attributes": tag(F.col("p_type")), "shape": F.md5("p_type"),
    }
    dx = F.when(k % 5 == 1, 0.5).when(k % 5 == 2, 2.0).when(k % 5 == 3, -30.0).otherwise(0.0)
    turn, swapped = F.when(k % 6 == 2, 360.0).when(k % 6 == 3, 0.01).otherwise(0.0), (k % 7 == 0) & (k % 4 == 1)
    points = [vertex(num(0), num(0), num(0)), vertex(s + F.when(k % 5 == 2, 3.0).otherwise(0.0), num(0), F.when(k % 6 == 1, 0.7).otherwise(0.5)), vertex(s, s, num(0))]
    new = old | {
        "x": F.when(swapped, x + 10).otherwise(x) + dx, "x2": F.when(swapped, x).otherwise(x + 10) + dx, "radius": s + F.when(k % 6 == 0, 0.1).otherwise(0.0), **normal(F.when(k % 9 == 0, -1.0).otherwise(1.0)), "angle": s * 10 + turn,
        "text": F.when(k % 11 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), "name": F.when(k % 13 == 0, "other").otherwise(F.col("p_brand")), "sx": F.when(k % 17 == 0, -1.0).otherwise(1.0),
        "closed": F.when(k % 19 == 0, k % 2 != 0).otherwise(k % 2 == 0), "vertices": F.when(k % 4 == 0, F.array(*points[:2])).otherwise(F.array(*points)), "attributes": tag(F.when(k % 23 == 0, "z").otherwise(F.col("p_type"))),
        "shape": F.when(k % 29 == 0, "h").otherwise(F.md5("p_type")),
    }
    rows = table(spark, sf_dir, "part").withColumn("d", shapes.shape_diffs(_pick(KINDS, k % 7), old, new))
    total = F.aggregate("d", F.lit(0.0), lambda a, v: a + F.coalesce(v["delta"], F.lit(0.0)))
    return rows.select("p_partkey", F.array_join(F.transform("d", lambda v: v["path"]), ",").alias("paths"), F.array_join(shapes.shape_categories(F.col("d")), ",").alias("categories"), F.rint(total * 1000).cast("long").alias("delta_milli"))


def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested value with every number at the quantum of its field."""
    c = F.col
    point = F.struct((c("p_retailprice") / 7).alias("x"), (c("p_size") / 3).alias("y"))
    value = F.struct(point.alias("at"), (c("p_retailprice") / 11).alias("start_angle"), (c("p_size") / 9).alias("scale_x"), F.array(point, F.struct(c("p_size").cast("double").alias("x"), F.lit(-0.004).alias("y"))).alias("points"), c("p_name").alias("label"))
    rows = table(spark, sf_dir, "part").select("p_partkey", value.alias("v"))
    r = shapes.rounded(F.col("v"), rows.schema["v"].dataType)
    steps = lambda v, q: F.rint(v / q).cast("long")
    return rows.select("p_partkey", steps(r["at"]["x"], 0.01).alias("x"), steps(r["start_angle"], 0.001).alias("angle"), steps(r["scale_x"], 1e-6).alias("scale"), F.transform(r["points"], lambda p: steps(p["y"], 0.01))[1].alias("y1"), steps(r["points"][0]["y"], 0.01).alias("y0"), r["label"].alias("label"))


def moved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of some layers, moved; only lines have another end."""
    c = F.col
    e = {"x": c("p_retailprice"), "y": c("p_size").cast("double"), "x2": c("p_retailprice") + 1, "y2": F.lit(2.0), "vertices": F.array(F.struct(c("p_retailprice").alias("x"), F.lit(0.0).alias("y")))}
    kind = F.when(c("p_partkey") % 2 == 0, "line").otherwise("circle")
    m = shapes.moved(kind, e, F.lit(5.0), F.lit(-1.0))
    kept = shapes.layer_kept(c("p_brand"), c("p_type"), ["promo", "ECONOMY ", "brand#1"], ["BRAND#13"])
    in_block = shapes.in_block_space(F.when(c("p_size") % 5 == 0, "Block"), F.lit(None).cast("string"), F.when(c("p_size") % 7 == 0, "block").otherwise("model"))
    milli = lambda v: F.rint(v * 1000).cast("long")
    return table(spark, sf_dir, "part").filter(kept).select("p_partkey", milli(m["x"]).alias("x_milli"), milli(m["x2"]).alias("x2_milli"), milli(m["y2"]).alias("y2_milli"), milli(m["vertices"][0]["x"]).alias("v_milli"), in_block.alias("in_block"))


def annotation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys and the largest group of equal ones, by kind."""
    c, k = F.col, F.col("p_partkey")
    kinds = ["dimension", "attrib", "hatch", "solid", "mleader", "leader", "spline", "ellipse", "line"]
    kind = _pick(kinds, k % 9)
    x, y = (c("p_size") % 5).cast("double"), (k % 2).cast("double")
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    points = F.when(c("p_size") % 2 == 0, F.array(corner(x, y), corner(y, x))).otherwise(F.array(corner(y, x), corner(x, y)))
    e = {
        "x": x, "y": y, "x2": x, "y2": F.lit(1.0), "angle": c("p_size") % 3 * 360.0, "angle2": F.lit(1.5), "ratio": F.lit(0.5), "measurement": F.round(c("p_size") / 10), "text": c("p_type"), "tag": c("p_brand"), "name": F.lower("p_type"), "scale": F.lit(1.0),
        "paths": F.lit(1), "degree": F.lit(3), "closed": c("p_size") % 2 == 0, "vertices": points,
    }
    rows = table(spark, sf_dir, "part").select(kind.alias("kind"), shapes.annotation_key(kind, e).alias("key")).groupBy("kind", "key").agg(F.count("*").alias("n"))
    return rows.groupBy("kind").agg(F.count("key").alias("keys"), F.max("n").alias("most"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as matched pairs of records."""
    c, k, s = F.col, F.col("p_partkey"), F.col("p_size")
    kind = _pick(["DIMENSION", "ATTRIB", "INSERT", "LINE"], k % 4)
    return table(spark, sf_dir, "part").select(
        k.alias("a_id"), (k + 1_000_000).alias("b_id"), kind.alias("kind"), F.when(s % 3 == 0, "S-BEAM").otherwise("MISC").alias("layer"), c("p_retailprice").alias("a_x"), F.lit(0.0).alias("a_y"), (c("p_retailprice") + F.when(s % 4 == 0, 0.5).when(s % 4 == 1, 3.0).otherwise(0.0)).alias("b_x"),
        F.lit(0.0).alias("b_y"), s.cast("double").alias("a_measure"), (s + F.when(k % 5 == 0, 2.0).otherwise(0.0)).alias("b_measure"), F.lit(0.0).alias("a_rotation"), F.when(k % 7 == 0, 360.0).when(k % 7 == 1, 5.0).otherwise(0.0).alias("b_rotation"), F.lit(1.0).alias("a_scale"),
        F.when(k % 6 == 0, 2.0).otherwise(1.0).alias("b_scale"), c("p_name").alias("a_text"), F.when(s % 5 == 0, c("p_type")).otherwise(c("p_name")).alias("b_text"), F.lit(1).alias("a_color"), F.when(k % 3 == 0, 2).when(k % 3 == 1, 1).alias("b_color"),
        F.lit(None).cast("int").alias("a_lineweight"), F.when(k % 8 == 0, 5).alias("b_lineweight"), c("p_brand").alias("a_linetype"), c("p_brand").alias("b_linetype"),
    )


def cosmetic_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose looks alone are told apart, and what is left when these are suppressed."""
    rows = channels.cosmetic(_pairs(spark, sf_dir)).select("a_id", "detail", "change_category", F.when(F.col("a_id") % 2 == 0, "modified").otherwise("added").alias("change_type"))
    return rows.join(channels.without_cosmetic(rows).select("a_id", F.lit(True).alias("kept")), "a_id", "left").select("a_id", "detail", F.coalesce("kept", F.lit(False)).alias("kept"))


def matched_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.matched_contents(_pairs(spark, sf_dir)).select("a_id", "b_id", "kind", "change_category")


def modified_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = channels.modified(_pairs(spark, sf_dir))
    return rows.select("a_id", "kind", "change_category", F.rint("measurement_diff").cast("long").alias("measure"), F.rint(F.col("moved") * 1000).cast("long").alias("moved_milli"))


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = _pick(["added", "deleted", "MODIFIED"], c("l_linenumber") % 3)
    value = keys.layer_priority(F.concat(F.lit("L"), (c("l_suppkey") % 12).cast("string")), [(2, ["L1*"]), (0, ["L2", "L3"]), (-1, ["L4"])])
    entity = _pick(["DIMENSION", "LINE", "HATCH", "INSERT"], c("l_suppkey") % 4)
    return table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("L"), (c("l_suppkey") % 12).cast("string")).alias("layer"), kind.alias("change_type"), F.when(c("l_quantity") > 30, "layer_move").otherwise("position").alias("change_category"),
        review.priority_class(value, entity).alias("priority"), (c("l_orderkey") % 1000).alias("pair"),
    )


def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.layer_report(_layered(spark, sf_dir))


def priority_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.priority_summary(channels.layer_report(_layered(spark, sf_dir)))


def enough_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = channels.enough_changes(_layered(spark, sf_dir).select("pair", "layer"), ["pair", "layer"], 6)
    return rows.groupBy("pair", "layer").agg(F.count("*").alias("n"))


def reorigin_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts far apart whose origin moved: some kinds by a shift that the first guess misses a little, some texts changed."""
    c, k = F.col, F.col("p_partkey")
    old = table(spark, sf_dir, "part").select(
        k.alias("id"), c("p_type").alias("group"), F.when(k % 3 == 0, "TEXT").otherwise("LINE").alias("kind"), F.lit("X").alias("layer"), (k * 40.0).alias("x"), (k % 7 * 100.0).alias("y"), c("p_name").alias("text"), F.lit("own").alias("data"),
    )
    new = old.select(
        (k_ := F.col("id")).alias("id"), "group", "kind", "layer", (F.col("x") + 5000.0 + F.when(F.col("group") == "PROMO", 2.5).otherwise(0.0) + F.when(k_ % 11 == 0, 2.0).otherwise(0.0)).alias("x"), "y", F.when(k_ % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.lit("new").alias("data"),
    )
    guess = old.select("group").distinct().withColumns({"dx": F.lit(-5000.0), "dy": F.lit(0.0)})

    def proof(dx, dy, most):
        side = lambda s: {"x": F.col(f"{s}_own_x"), "y": F.col(f"{s}_own_y"), "x2": F.col(f"{s}_own_x") + 7, "y2": F.col(f"{s}_own_y"), "text": F.col(f"{s}_text"), "data": F.col(f"{s}_data")} | {n: F.lit(1.0) for n in ("radius", "angle", "angle2", "sx", "sy", "measure")} | {"name": F.lit("n"), "closed": F.lit(False), "vertices": F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))}
        return channels.same_when_registered(F.col("kind"), side("a"), side("b"), dx, dy, most)

    return channels.reorigin_unchanged(old, new, ["group"], guess, proof, lambda layer: F.lit(1.0)).select("group", "a_id", "b_id")


def frame_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    a = g.box(F.lit(0.0), F.lit(0.0), c("p_retailprice"), F.lit(600.0))
    b = g.box(F.lit(10.0), F.lit(10.0), c("p_retailprice") + 10 + c("p_size") * 2, F.lit(610.0))
    wide = F.when(c("p_partkey") % 10 == 0, 0).otherwise(1600)
    sheet, page = shapes.sheet_alignment(a, b), shapes.page_alignment(a, wide, F.lit(1000))
    local = shapes.in_frame(a, g.box(F.lit(60.0), F.lit(60.0), F.lit(120.0), F.lit(120.0)))
    back = shapes.frame_box(a, local)
    return table(spark, sf_dir, "part").select("p_partkey", sheet["quality"].alias("sheet"), F.rint(sheet["mismatch"] * 1e6).cast("long").alias("mismatch_micro"), page["quality"].alias("page"), F.rint(local["x1"] * 1e6).cast("long").alias("local_micro"), F.rint(back["x1"] * 1000).cast("long").alias("back_milli"))


QUERIES = {
    f.__name__: f
    for f in (shape_diffs, rounded_values, moved_entities, annotation_keys, cosmetic_channel, matched_contents, modified_changes, layer_report, priority_summary, enough_changes, reorigin_unchanged, frame_alignments)
}

_LIST = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"
_PAIRS = """v AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 4 AS t, CASE WHEN p_size % 3 = 0 THEN 0.1::DOUBLE ELSE 1 END AS lim, CASE p_size % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 3 ELSE 0 END AS m, p_size % 5 = 0 AND p_type <> p_name AS reworded FROM part),
c AS (SELECT *, ['DIMENSION', 'ATTRIB', 'INSERT', 'LINE'][t + 1] AS kind, list_filter([CASE WHEN m >= lim THEN 'position' END, CASE WHEN t = 0 AND k % 5 = 0 THEN 'dimension' END, CASE WHEN k % 7 = 1 THEN 'rotation' END, CASE WHEN t = 2 AND k % 6 = 0 THEN 'scale' END, CASE WHEN t IN (1, 2) AND reworded THEN 'content' END], lambda x: x IS NOT NULL) AS l0 FROM v),
d AS (SELECT *, CASE WHEN len(l0) = 0 THEN 'content' ELSE array_to_string(l0, ',') END AS change_category FROM c)"""
_LAYERED = """v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'L' || l_suppkey % 12 AS layer, l_linenumber % 3 AS t, l_quantity > 30 AS mv, l_orderkey % 1000 AS pair, l_suppkey % 12 AS n, l_suppkey % 4 AS e FROM lineitem),
p AS (SELECT *, CASE WHEN n IN (1, 10, 11) THEN CASE WHEN e = 0 THEN 'critical' ELSE 'high' END WHEN n IN (2, 3, 4) THEN 'low' WHEN e IN (0, 3) THEN 'high' WHEN e = 2 THEN 'low' ELSE 'medium' END AS priority FROM v),
r AS (SELECT layer, count(*) FILTER (t = 0) AS added, count(*) FILTER (t = 1) AS deleted, count(*) FILTER (t = 2 AND NOT mv) AS modified, count(*) FILTER (t = 2 AND mv) AS layer_moves, first(priority ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS priority FROM p GROUP BY layer)"""

ORACLE_SQL = {
    "shape_diffs": f"""WITH v AS (SELECT p_partkey, p_partkey AS k, p_partkey % 7 AS t, [0, 0.5, 2, -30, 0][p_partkey % 5 + 1]::DOUBLE AS dx FROM part), m AS (SELECT *, abs(dx) > 1 AS moved FROM v),
    f AS (SELECT p_partkey, CASE t WHEN 0 THEN {_LIST.format("CASE WHEN moved THEN 'geometry.start' END, CASE WHEN moved THEN 'geometry.end' END")}
      WHEN 1 THEN {_LIST.format("CASE WHEN moved THEN 'geometry.center' END, CASE WHEN k % 6 = 0 THEN 'geometry.radius' END, CASE WHEN k % 9 = 0 THEN 'geometry.normal' END")}
      WHEN 2 THEN {_LIST.format("CASE WHEN moved THEN 'geometry.center' END, CASE WHEN k % 6 = 0 THEN 'geometry.radius' END, CASE WHEN k % 9 = 0 THEN 'geometry.normal' END, CASE WHEN k % 6 = 3 THEN 'geometry.start_angle_deg' END")}
      WHEN 3 THEN {_LIST.format("CASE WHEN k % 19 = 0 THEN 'geometry.closed' END, CASE WHEN k % 4 = 0 THEN 'geometry.vertex_count' END, CASE WHEN k % 5 = 2 THEN 'geometry.vertices[1].point' END, CASE WHEN k % 6 = 1 THEN 'geometry.vertices[1].bulge' END")}
      WHEN 4 THEN {_LIST.format("CASE WHEN moved THEN 'geometry.insert' END, CASE WHEN k % 6 = 3 THEN 'geometry.rotation_deg' END, CASE WHEN k % 11 = 0 THEN 'geometry.canonical_text' END")}
      WHEN 5 THEN {_LIST.format("CASE WHEN k % 13 = 0 THEN 'geometry.block_name' END, CASE WHEN moved THEN 'geometry.insert' END, CASE WHEN k % 17 = 0 THEN 'geometry.scale' END, CASE WHEN k % 6 = 3 THEN 'geometry.rotation_deg' END, CASE WHEN k % 23 = 0 THEN 'geometry.attributes' END")}
      ELSE CASE WHEN k % 29 = 0 THEN 'geometry.hash' ELSE '' END END AS paths,
      CASE WHEN moved AND t IN (1, 2, 4, 5) THEN abs(dx) WHEN moved AND t = 0 THEN 2 * abs(dx) ELSE 0 END + CASE WHEN t IN (1, 2) AND k % 6 = 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN t IN (1, 2) AND k % 9 = 0 THEN 2 ELSE 0 END + CASE WHEN t IN (2, 4, 5) AND k % 6 = 3 THEN 0.01::DOUBLE ELSE 0 END
      + CASE WHEN t = 3 AND k % 4 = 0 THEN -1 ELSE 0 END + CASE WHEN t = 3 AND k % 5 = 2 THEN 3 ELSE 0 END + CASE WHEN t = 3 AND k % 6 = 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN t = 5 AND k % 17 = 0 THEN 2 ELSE 0 END AS total FROM m)
    SELECT p_partkey, paths, array_to_string(list_filter([CASE WHEN paths LIKE '%block_name%' THEN 'block' END, CASE WHEN len(list_filter(string_split(paths, ','), lambda p: p <> '' AND p NOT IN ('geometry.block_name', 'geometry.attributes', 'geometry.canonical_text'))) > 0 THEN 'geometry' END,
      CASE WHEN paths LIKE '%attributes%' OR paths LIKE '%canonical%' THEN 'text' END], lambda x: x IS NOT NULL), ',') AS categories, CAST(round_even(total * 1000, 0) AS BIGINT) AS delta_milli FROM f""",
    "rounded_values": """SELECT p_partkey, CAST(round_even(p_retailprice / 7 / 0.01::DOUBLE, 0) AS BIGINT) AS x, CAST(round_even(p_retailprice / 11 / 0.001::DOUBLE, 0) AS BIGINT) AS angle, CAST(round_even(p_size / 9::DOUBLE / 1e-6::DOUBLE, 0) AS BIGINT) AS scale, 0::BIGINT AS y1, CAST(round_even(p_size / 3::DOUBLE / 0.01::DOUBLE, 0) AS BIGINT) AS y0, p_name AS label FROM part""",
    "moved_entities": """SELECT p_partkey, CAST(round_even((p_retailprice + 5) * 1000, 0) AS BIGINT) AS x_milli, CAST(round_even((p_retailprice + 1 + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END) * 1000, 0) AS BIGINT) AS x2_milli, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 2000 END AS BIGINT) AS y2_milli,
      CAST(round_even((p_retailprice + 5) * 1000, 0) AS BIGINT) AS v_milli, p_size % 5 = 0 OR p_size % 7 = 0 AS in_block FROM part WHERE (lower(p_type) IN ('promo', 'economy') OR lower(p_brand) = 'brand#1') AND lower(p_brand) <> 'brand#13'""",
    "annotation_keys": """WITH v AS (SELECT p_partkey % 9 AS t, p_size % 5 AS x, p_partkey % 2 AS y, p_type, p_brand, p_size % 2 = 0 AS e, round(p_size / 10::DOUBLE) AS m FROM part),
    w AS (SELECT t, CASE t WHEN 0 THEN x || ',' || y || ',' || m || p_type WHEN 1 THEN p_brand || x || ',' || y WHEN 2 THEN upper(p_type) || least(x, y) || ',' || greatest(x, y) WHEN 3 THEN least(x, y) || ',' || greatest(x, y) WHEN 4 THEN x || ',' || y || p_type WHEN 5 THEN CASE WHEN e THEN x || ',' || y ELSE y || ',' || x END
      WHEN 6 THEN e || CASE WHEN e THEN x || ',' || y ELSE y || ',' || x END WHEN 7 THEN x || ',' || y END AS k, e FROM v),
    a AS (SELECT p_partkey % 9 AS t, p_size % 5 AS x, p_partkey % 2 AS y, (p_size % 3) * 360 AS g FROM part),
    n AS (SELECT t, k, count(*) AS n FROM w WHERE t <> 7 GROUP BY ALL UNION ALL SELECT t, x || ',' || y || ',' || g, count(*) FROM a WHERE t = 7 GROUP BY ALL)
    SELECT ['dimension', 'attrib', 'hatch', 'solid', 'mleader', 'leader', 'spline', 'ellipse', 'line'][t + 1] AS kind, count(k) AS keys, max(n) AS most FROM n GROUP BY t""",
    "cosmetic_channel": """WITH v AS (SELECT p_partkey AS a_id, array_to_string(list_filter([CASE p_partkey % 3 WHEN 0 THEN 'color: 1 → 2' WHEN 2 THEN 'color: 1 → None' END, CASE WHEN p_partkey % 8 = 0 THEN 'lineweight: None → 5' END], lambda x: x IS NOT NULL), '; ') AS detail FROM part)
    SELECT a_id, detail, a_id % 2 = 1 AS kept FROM v WHERE detail <> ''""",
    "matched_contents": f"WITH {_PAIRS} SELECT k AS a_id, k + 1000000 AS b_id, kind, change_category FROM d WHERE t = 1 AND reworded AND NOT (change_category = 'position' AND m < lim)",
    "modified_changes": f"WITH {_PAIRS} SELECT k AS a_id, kind, change_category, CAST(CASE WHEN t = 0 THEN CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END END AS BIGINT) AS measure, CAST(m * 1000 AS BIGINT) AS moved_milli FROM d WHERE NOT (change_category = 'position' AND m < lim)",
    "layer_report": f"WITH {_LAYERED} SELECT * FROM r",
    "priority_summary": f"WITH {_LAYERED} SELECT priority, CAST(sum(added + deleted + modified + layer_moves) AS BIGINT) AS changes, count(*) AS layers FROM r GROUP BY priority",
    "enough_changes": "SELECT l_orderkey % 1000 AS pair, 'L' || l_suppkey % 12 AS layer, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 6",
    "reorigin_unchanged": """WITH v AS (SELECT p_type AS g, p_partkey AS k, CASE WHEN p_type = 'PROMO' THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 0 END AS off, p_partkey % 3 = 0 AND p_partkey % 5 = 0 AS reworded FROM part),
    f AS (SELECT *, off <= 3 AND NOT reworded AS hit FROM v), q AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY -off) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM f WHERE hit), m AS (SELECT g, max(-off) AS mx FROM q WHERE r = n // 2 AND n >= 4 GROUP BY g)
    SELECT g AS "group", k AS a_id, k AS b_id FROM v LEFT JOIN m USING (g) WHERE abs(off + coalesce(mx, 0)) <= 1 AND NOT reworded""",
    "frame_alignments": """WITH v AS (SELECT p_partkey, p_retailprice / 600 AS a, (p_retailprice + p_size * 2) / 600 AS b, p_partkey % 10 = 0 AS bare, p_retailprice AS w FROM part), o AS (SELECT *, abs(a - b) / b AS off, abs(a - 1.6::DOUBLE) / 1.6::DOUBLE AS poff FROM v)
    SELECT p_partkey, CASE WHEN off <= 0.02::DOUBLE THEN 'exact' WHEN off <= 0.08::DOUBLE THEN 'estimated' END AS sheet, CAST(round_even(off * 1e6, 0) AS BIGINT) AS mismatch_micro, CASE WHEN bare THEN 'relative_only' WHEN poff <= 0.02::DOUBLE THEN 'exact' ELSE 'estimated' END AS page,
      CAST(round_even(120 / w * 1e6, 0) AS BIGINT) AS local_micro, 120000::BIGINT AS back_milli FROM o""",
}
