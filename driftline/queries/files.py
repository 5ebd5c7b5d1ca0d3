"""Files that a query writes to the shared folder and reads back: drawings end to end, streams, states, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import changes as ch
from driftline.functions import geometry as g
from driftline.functions import keys
from driftline.functions import text as t
from driftline.operators import tablediff
from driftline.plans import drawings
from driftline.plans.scratch import Scratch
from driftline.queries.common import table
from driftline.sources import dxf, records, reports

def _drawing() -> F.Column:
    return F.regexp_extract("path", "drawing=([^/]+)", 1)


def _pick(values: list, index) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _rows(section: str, ordinal: int, raw_type: str, **values):
    return F.struct(F.lit(section).alias("section"), F.lit(ordinal).cast("long").alias("ordinal"), F.lit(raw_type).alias("raw_type"), dxf.fields(**{k: [F.lit(x) for x in v] if isinstance(v, list) else F.lit(v) for k, v in values.items()}).alias("fields"))


def _drawn(spark: SparkSession, sf_dir: str, revised: bool) -> DataFrame:
    """Parts as entities of ten drawings, with a layer table and a block; the revision has some gone, moved, reworded, on another layer."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part")
    layer, text, x = F.when(k % 6 == 0, "S-BEAM").otherwise("MISC"), F.col("p_name"), k * 200.0
    if revised:
        p = p.filter("p_partkey % 13 <> 0")
        layer, text = F.when(k % 19 == 0, "MOVED").otherwise(layer), F.when(k % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text)
        x = x + F.when(k % 17 == 0, 4.0).when(k % 7 == 0, 2.0).when(k % 11 == 0, 0.5).otherwise(0.0)
    of, only = k % 5, lambda kind, v: F.when(k % 5 == kind, v)
    body = dxf.fields(
        g8=layer, g2=only(3, F.lit("DOOR")), g70=only(4, F.lit("1")), g10=[x, only(4, x + 10), only(4, x + 10)], g20=[s, only(4, s), only(4, s + 10)], g11=only(0, x + 50), g21=only(0, s), g40=F.when(of.isin(1, 2), 2.5), g1=only(2, text), g41=only(3, F.lit(2.0)),
        g42=only(3, F.lit(2.0)), g50=only(3, F.lit(90.0)),
    )
    # a polyline's coordinates come in pairs
    pairs = F.flatten(F.array(*[F.array(F.struct(F.lit("10").alias("code"), (x + a).cast("string").alias("value")), F.struct(F.lit("20").alias("code"), (s + b).cast("string").alias("value"))) for a, b in ((0, 0), (10, 0), (10, 10))]))
    body = F.when(of == 4, F.concat(dxf.fields(g8=layer, g70=F.lit("1")), pairs)).otherwise(F.filter(body, lambda f: f["code"] != "70"))
    own = p.select(F.concat(F.lit("d"), (k % 10).cast("string")).alias("drawing"), F.lit("ENTITIES").alias("section"), k.alias("ordinal"), _pick(["LINE", "CIRCLE", "TEXT", "INSERT", "LWPOLYLINE"], of).alias("raw_type"), body.alias("fields"))
    fixed = F.array(
        _rows("TABLES", 1, "LAYER", g2="S-BEAM", g62="3"), _rows("BLOCKS", 1, "BLOCK", g2="DOOR"), _rows("BLOCKS", 2, "CIRCLE", g8="0", g10="1", g20="2", g40="0.5"), _rows("BLOCKS", 3, "LINE", g8="A-BLK", g10="0", g20="0", g11="1", g21="0"), _rows("BLOCKS", 4, "ENDBLK"),
        _rows("ENTITIES", 1 << 40, "3DFACE", g8="X"), _rows("ENTITIES", (1 << 40) + 1, "LINE", g67="1", g410="Sheet 1", g8="PAPER", g10="0", g20="0", g11="9", g21="0"),
    )
    names = p.select(F.concat(F.lit("d"), (k % 10).cast("string")).alias("drawing")).distinct()
    return own.unionByName(names.select("drawing", F.explode(fixed).alias("r")).select("drawing", "r.*"))


def _read(spark: SparkSession, sf_dir: str, revised: bool = False) -> DataFrame:
    scratch = Scratch(spark, "drawings")
    folder = scratch.path("new" if revised else "old")
    dxf.written(_drawn(spark, sf_dir, revised), folder)
    return scratch.write(dxf.read(spark, folder, "*.txt"), "read")


def drawing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of drawing files as they are read, by type, space and status."""
    rows = _read(spark, sf_dir).withColumn("drawing", _drawing())
    return rows.groupBy("drawing", "raw_type", "status", "space").agg(F.count("*").alias("n"), F.sum(F.rint(F.coalesce("x", F.lit(0.0)))).cast("long").alias("x_sum"), F.sum(F.size(F.coalesce("vertices", F.array().cast("array<struct<x:double,y:double,bulge:double>>")))).alias("corners"))


def drawing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dxf.layers(_read(spark, sf_dir)).select(_drawing().alias("drawing"), "layer")


def drawing_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dxf.unsupported(_read(spark, sf_dir)).select(_drawing().alias("drawing"), "raw_type", "n")


def drawing_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of a paper layout, and how many the model has."""
    rows = _read(spark, sf_dir)
    count = lambda name: dxf.of_layout(rows, name).groupBy(_drawing().alias("drawing")).agg(F.count("*").alias("n"), F.max("layer").alias("last_layer")).withColumn("layout", F.lit(name))
    return count("Sheet 1").unionByName(count("Model"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (drawings.entities(_read(spark, sf_dir, revised), _drawing()) for revised in (False, True))
    scratch = Scratch(spark, "drawing-diff")
    return drawings.changes(scratch.write(old, "old"), scratch.write(new, "new"))


def drawing_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of drawing files, from the files to the changes."""
    return _changes(spark, sf_dir).groupBy("drawing", "entity_type", "layer", "change_type", "paths", "category").agg(F.count("*").alias("n"))


def drawing_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as zones of changes."""
    return drawings.zone_summary(_changes(spark, sf_dir), 20_000.0).groupBy("drawing", "severity", "change_type").agg(F.count("*").alias("zones"), F.sum("n").alias("changes"))


def _change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), (c("o_custkey") % 50).cast("string")).alias("pair_id"), _pick(["added", "deleted", "modified"], c("o_orderkey") % 3).alias("change_type"), c("o_orderstatus").alias("entity_type"), c("o_orderpriority").alias("layer"),
        F.when(c("o_orderkey") % 10 > 0, c("o_totalprice")).alias("x0"), F.lit(0.0).alias("y0"), (c("o_totalprice") + 1).alias("x1"), F.lit(1.0).alias("y1"),
    )


def change_stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream written and read: changes without a box are counted and left out."""
    path = Scratch(spark, "stream").path("changes")
    dropped = records.write_changes(_change_rows(spark, sf_dir), path)
    return records.read_changes(spark, path).groupBy("pair_id", "change_type", "layer").agg(F.count("*").alias("n"), F.sum(F.rint("x0")).cast("long").alias("x_sum")).withColumn("without_box", F.lit(dropped).cast("long"))


def perf_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry appended in two writes, with a line that is none."""
    path = Scratch(spark, "perf").path("log")
    e = table(spark, sf_dir, "events")
    lines = lambda part: e.filter(F.col("event_id") % 2 == part).select(F.when(F.col("event_id") % 50 == 0, "no json").otherwise(F.to_json(F.struct(F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"), (F.col("user_id") % 2 == 0).alias("cache_hit")))).alias("value"))
    lines(0).write.mode("overwrite").text(path)
    lines(1).write.mode("append").text(path)
    return records.read_perf(spark, path).filter("stage IS NOT NULL").groupBy("stage", "cache_hit").agg(F.count("*").alias("n"), F.sum(F.rint(F.col("elapsed_ms") * 100)).cast("long").alias("cents"))


def manual_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "manual").path("decisions")
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("a_path"), F.concat(F.lit("new/"), "s_name").alias("b_path"), _pick([" Confirmed ", "REJECTED"], F.col("s_suppkey") % 2).alias("status"), F.lit("a, \"b\"").alias("note"))
    s.write.mode("overwrite").option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("escape", "\"").csv(path)
    return records.read_manual(spark, path).select("a_path", "b_path", "status")


def compare_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results kept by pair, one pair read alone."""
    path = Scratch(spark, "state").path("state")
    records.write_state(_change_rows(spark, sf_dir), path)
    return records.read_state(spark, path).filter("pair_id = 'p7'").select("pair_id", "change_type", "entity_type", "layer", F.rint("x1").cast("long").alias("x1"))


def overlay_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay rows in pages; one page is one read."""
    path = Scratch(spark, "overlays").path("pages")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    records.write_pages(rows, path, "c_nationkey", ["c_custkey"], 3)
    return records.read_page(spark, path, "c_nationkey", 5, 1).select("c_nationkey", "c_custkey", F.col("page").cast("long").alias("page"))


def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of exported files that still hold a path."""
    path = Scratch(spark, "audit").path("texts")
    table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("see C:\\x\\"), "p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("at /home/u/"), "p_name")).otherwise(F.concat(F.lit("<path>/"), "p_name")).alias("value")).write.mode("overwrite").text(path)
    return records.audit_folder(spark, path).groupBy("value").agg(F.count("*").alias("n"))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder by kind, and their names."""
    path = Scratch(spark, "listing").path("files")
    dxf.written(_drawn(spark, sf_dir, False), path)
    rows = records.listing(spark, path, ["txt", "dxf"])
    return rows.select(F.regexp_extract("path", "drawing=([^/]+)", 1).alias("drawing"), "kind", (F.col("length") > 100).alias("filled"))


def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose contents no earlier result has, and the digests of their rows."""
    c = F.col
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("hash_a"), F.md5("p_type").alias("hash_b"))
    cache = table(spark, sf_dir, "part").filter("p_size > 25").select(F.md5("p_name").alias("hash_a"), F.md5("p_type").alias("hash_b"))
    fresh = records.new_pairs(pairs, cache.distinct())
    marked = records.provenance(fresh.select("p_partkey", "hash_a"), exclude=("p_partkey",))
    return marked.select(c("p_partkey"), c("provenance"))


def descriptor_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose descriptor is cached for their size and the options, and files that must be read."""
    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_size").alias("length"), F.col("p_partkey").alias("modificationTime"))
    old = files.filter("modificationTime % 3 = 0").withColumn("length", F.when(F.col("length") % 2 == 0, F.col("length") + 1).otherwise(F.col("length")))
    cache = old.select(reports.signature(("path", "length", "modificationTime"), "v1").alias("signature"), F.lit(7).alias("entities"))
    hits, misses = reports.cached(files, cache, "v1")
    return hits.select("modificationTime", "entities").unionByName(misses.select("modificationTime", F.lit(None).cast("int").alias("entities")))


def adapter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings that another reader wrote as JSON documents."""
    path = Scratch(spark, "adapter").path("json")
    c = F.col
    e = F.struct(c("c_custkey").cast("string").alias("id"), F.lit("text").alias("type"), F.concat(F.lit("l"), (c("c_custkey") % 3).cast("string")).alias("layer_id"), c("c_acctbal").alias("x"), F.lit(1.0).alias("y"), c("c_mktsegment").alias("text"))
    layers = F.array(*[F.struct(F.lit(f"l{i}").alias("id"), F.lit(n).alias("name"), F.lit("7").alias("color"), F.lit("CONTINUOUS").alias("linetype")) for i, n in enumerate(["WALL", "GRID"])])
    docs = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), c("c_nationkey").cast("string")).alias("drawing")).agg(F.collect_list(e).alias("entities"))
    docs.select("drawing", F.lit("mm").alias("units"), layers.alias("layers"), "entities", c("drawing").alias("part")).repartition("part").write.mode("overwrite").partitionBy("part").json(path)
    # a document a line: what a file of several documents holds is read by lines
    docs = spark.read.schema(records.ADAPTER).json(path)
    rows = docs.select("drawing", "units", F.explode_outer("entities").alias("e"), "layers")
    layer = F.get(F.filter("layers", lambda x: x["id"] == c("e.layer_id")), 0)
    return rows.select("drawing", "units", "e.id", layer["name"].alias("layer_name"), "e.text")


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").groupBy((c("o_custkey") % 40).alias("pair_id"), c("o_orderstatus").alias("zone_id")).agg(
        F.lit("D1").alias("drawing_number"), F.lit("modified").alias("change_type"), F.max("o_orderpriority").alias("severity"), F.count("*").alias("raw_change_count"), F.min("o_totalprice").alias("x0"), F.lit(0.12345).alias("y0"), F.max("o_totalprice").alias("x1"), F.lit(5.0).alias("y1"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("layers"), F.array(F.lit("LINE"), F.lit("TEXT")).alias("entity_types"), F.when(F.count("*") % 3 == 0, "max_region_cap").alias("reason"),
    )


def zone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones written as files and read back as text."""
    path = Scratch(spark, "zones").path("zones")
    reports.write_zones(_zones(spark, sf_dir), path)
    rows = reports.read_zones(spark, path)
    return rows.select("pair_id", "zone_id", "severity", "raw_change_count", F.col("bbox_min_y").alias("y0"), "layers", "entity_types", F.coalesce("status", F.lit("")).alias("status"), F.rint(F.col("bbox_max_x").cast("double")).cast("long").alias("x1"))


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a batch; the manifest, beside what the file of omitted zones has."""
    path = Scratch(spark, "artifacts").path("batch")
    manifest = reports.write_artifacts(_zones(spark, sf_dir), path)
    omitted = spark.read.option("header", "true").csv(f"{path}/omitted_zones").groupBy(F.col("pair_id").cast("long").alias("pair_id")).agg(F.count("*").alias("omitted_rows"), F.min("omitted_reason").alias("reason"))
    return manifest.join(omitted, "pair_id", "left")


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table comparison written as a report and a result, read back."""
    path = Scratch(spark, "results").path("report")
    rows = _change_rows(spark, sf_dir)
    summary = rows.groupBy("change_type").agg(F.count("*").alias("n"))
    reports.write_table_report(rows, summary, f"{path}/table", "csv")
    reports.write_result(summary, rows, f"{path}/run")
    a = spark.read.option("header", "true").csv(f"{path}/table/changes").groupBy("change_type").agg(F.count("*").alias("report_rows"))
    b = spark.read.json(f"{path}/run/items").groupBy("change_type").agg(F.count("x0").alias("boxes"))
    return spark.read.json(f"{path}/run/summary").join(a, "change_type").join(b, "change_type")


def dashboard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dashboard's files: the short list of issues is the first hundred by priority."""
    path = Scratch(spark, "dashboard").path("files")
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("zone_id"), F.col("o_totalprice").alias("priority_score"))
    drawn = table(spark, sf_dir, "nation").select(F.col("n_name").alias("drawing"))
    reports.write_dashboard(issues, drawn, drawn.withColumnRenamed("drawing", "pattern"), path)
    return spark.read.option("header", "true").csv(f"{path}/review_priority").select(F.col("zone_id").cast("long").alias("zone_id"))


def cloud_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision clouds around parts' boxes: their arcs and the length of their outline."""
    z = table(spark, sf_dir, "part").select(F.lit("p").alias("pair_id"), F.col("p_partkey").alias("zone_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 9 + 1.0).alias("y1"))
    rows = reports.cloud_marks(z, 5.0)
    return rows.select("zone_id", F.size("vertices").alias("arcs"), F.rint(F.array_max(F.transform("vertices", lambda v: v["x"])) * 1000).cast("long").alias("right_milli"), F.rint(F.get("vertices", 1)["x"] * 1000).cast("long").alias("second_milli"))


def curve_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves as polylines, outlines turned round, object axes, affine maps, pixel boxes, anchors."""
    c, k, s = F.col, F.col("p_partkey"), F.col("p_size").cast("double")
    milli = lambda v: F.rint(v * 1000).cast("long")
    ring = g.ellipse_points(s, F.lit(1.0), F.lit(4.0), F.lit(2.0), F.lit(0.0), 8)
    flat = keys.flattened(F.array(*[F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y")) for x in (F.lit(0), s, s * 2)]), 4)
    corner = lambda x, y, b: F.struct(x.alias("x"), y.alias("y"), b.alias("bulge"))
    back = keys.reversed_outline(F.array(corner(F.lit(0.0), F.lit(0.0), F.lit(0.5)), corner(s, F.lit(0.0), F.lit(0.0)), corner(s, s, F.lit(-1.0))))
    world = g.arbitrary_axis(F.lit(0.0), F.lit(0.0), F.lit(-1.0), s, F.lit(2.0), F.lit(3.0))
    matrix = F.array(*[F.lit(float(v)) for v in (0, -2, 0, 5, 2, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 1)])
    put = g.affine_box(matrix, g.box(F.lit(0.0), F.lit(0.0), s, F.lit(1.0)))
    fit = g.fit_to_pixels(g.box(F.lit(0.0), F.lit(0.0), s, s), F.lit(200), F.lit(100), 10.0)
    pixel, inch = g.to_pixel(fit, s, s), g.points_to_pixels(g.box(F.lit(0.0), F.lit(0.0), s, F.lit(72.0)), 144.0)
    anchor = g.anchored(g.box(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)), s, F.lit(2.0))
    return table(spark, sf_dir, "part").select(
        k, F.size(ring).alias("n_ring"), milli(F.get(ring, 2)["y"]).alias("ring_top"), F.size(flat).alias("n_flat"), milli(F.get(flat, 1)["x"]).alias("flat_x"), milli(F.get(back, 0)["bulge"]).alias("back_bulge"), milli(F.get(back, 1)["bulge"]).alias("back_bulge_1"), milli(world["x"]).alias("world_x"), milli(world["z"]).alias("world_z"),
        milli(put["x0"]).alias("put_x0"), milli(put["y1"]).alias("put_y1"), milli(pixel["x"]).alias("pixel_x"), milli(pixel["y"]).alias("pixel_y"), milli(inch["x1"]).alias("inch_x"), milli(anchor["x0"]).alias("anchor_x"), g.cloud_chords(g.box(F.lit(0.0), F.lit(0.0), s, F.lit(1.0)), 3.0).alias("chords"),
    )


def settings_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets and settings by file as limits, the key that a table's columns suggest, likeness of tokens."""
    c = F.col
    s = ch.Sensitivity.from_yaml("sensitivity: {preset: relaxed, rotation: 0.25, unknown: 3}")
    rows = table(spark, sf_dir, "part")
    key = tablediff.detect_key(rows.select("p_name", "p_partkey", "p_type"), rows.drop("p_name"))
    likeness = t.token_similarity(t.tokens(c("p_name")), t.tokens(F.concat(F.lit("red "), F.substring_index("p_name", " ", -1))))
    return rows.select("p_partkey", F.lit(s.rotation).alias("rotation"), F.lit(s.position).alias("position"), F.lit(ch.Sensitivity.preset("strict").radius).alias("radius"), F.lit(key).alias("key"), F.rint(likeness * 1e6).cast("long").alias("likeness_micro"))


QUERIES = {
    f.__name__: f
    for f in (
        drawing_scan, drawing_layers, drawing_unsupported, drawing_layout, drawing_diff, drawing_zones, change_stream_store, perf_log, manual_decisions, compare_state, overlay_store, leak_audit, file_listing, result_cache, descriptor_cache, adapter_scan,
        zone_files, artifact_files, result_files, dashboard_files, cloud_marks, curve_geometry, settings_and_keys,
    )
}

_NAMES = "n AS (SELECT DISTINCT 'd' || p_partkey % 10 AS drawing FROM part)"
_DIFF = """b AS (SELECT p_partkey AS k, 'd' || p_partkey % 10 AS drawing, p_partkey % 5 AS t, CASE WHEN p_partkey % 6 = 0 THEN 'S-BEAM' ELSE 'MISC' END AS layer, p_partkey % 13 <> 0 AS stays, CASE WHEN p_partkey % 17 = 0 THEN 4 WHEN p_partkey % 7 = 0 THEN 2 WHEN p_partkey % 11 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS shift,
  p_partkey % 19 = 0 AS relayered, p_partkey % 3 = 0 AND p_partkey % 5 = 2 AS reworded, p_partkey * 200.0::DOUBLE AS x, p_size AS y FROM part),
e AS (SELECT *, ['LINE', 'CIRCLE', 'TEXT', 'INSERT', 'LWPOLYLINE'][t + 1] AS entity_type, relayered AS lay, 0 AS part FROM b UNION ALL SELECT *, 'CIRCLE', relayered, 1 FROM b WHERE t = 3 UNION ALL SELECT * REPLACE ('A-BLK' AS layer), 'LINE', false, 2 FROM b WHERE t = 3),
s AS (SELECT *, stays AND 0.25 + 0.15 * CASE WHEN lay THEN 0.35 ELSE 1 END + 0.20 * CASE WHEN part = 0 AND t IN (0, 1, 4) THEN 1 WHEN part = 1 THEN CASE WHEN shift > 2 THEN 1 - (shift - 2) / 5 ELSE 1 END ELSE 1 - shift / 5 END + 0.20 * (1 - shift / 5)
    + CASE WHEN shift = 0 THEN 0.20 ELSE 0 END >= 0.62 AS paired, shift > 1 AS moved FROM e),
f AS (SELECT *, list_filter(list_concat(CASE WHEN moved THEN CASE entity_type WHEN 'LINE' THEN ['geometry.start', 'geometry.end'] WHEN 'CIRCLE' THEN ['geometry.center'] WHEN 'LWPOLYLINE' THEN ['geometry.vertices[0].point', 'geometry.vertices[1].point', 'geometry.vertices[2].point'] ELSE ['geometry.insert'] END ELSE [] END,
  list_concat(CASE WHEN reworded THEN ['geometry.canonical_text'] ELSE [] END, CASE WHEN lay THEN ['layer'] ELSE [] END)), lambda v: v IS NOT NULL) AS p FROM s),
d AS (SELECT drawing, entity_type, CASE WHEN lay THEN 'MOVED' ELSE layer END AS layer, CASE WHEN len(p) = 0 THEN 'unchanged' ELSE 'modified' END AS change_type, array_to_string(p, ',') AS paths, array_to_string(list_filter([CASE WHEN moved THEN 'geometry' END, CASE WHEN lay THEN 'layer' END, CASE WHEN reworded THEN 'text' END], lambda v: v IS NOT NULL), ',') AS category,
    x + shift + CASE part WHEN 1 THEN -4 ELSE 0 END AS px, y + CASE part WHEN 1 THEN 2 ELSE 0 END AS py FROM f WHERE paired
  UNION ALL SELECT drawing, entity_type, layer, 'deleted', '', '', x + CASE part WHEN 1 THEN -4 ELSE 0 END, y + CASE part WHEN 1 THEN 2 ELSE 0 END FROM f WHERE NOT paired
  UNION ALL SELECT drawing, entity_type, CASE WHEN lay THEN 'MOVED' ELSE layer END, 'added', '', '', x + shift + CASE part WHEN 1 THEN -4 ELSE 0 END, y + CASE part WHEN 1 THEN 2 ELSE 0 END FROM f WHERE NOT paired AND stays)"""
_CHANGES = "c AS (SELECT 'p' || o_custkey % 50 AS pair_id, ['added', 'deleted', 'modified'][o_orderkey % 3 + 1] AS change_type, o_orderstatus AS entity_type, o_orderpriority AS layer, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS x0, o_totalprice + 1 AS x1 FROM orders)"
_ZONES = "z AS (SELECT o_custkey % 40 AS pair_id, o_orderstatus AS zone_id, max(o_orderpriority) AS severity, count(*) AS n, max(o_totalprice) AS x1 FROM orders GROUP BY 1, 2)"

ORACLE_SQL = {
    "drawing_scan": f"""WITH {_NAMES}, v AS (SELECT 'd' || p_partkey % 10 AS drawing, ['LINE', 'CIRCLE', 'TEXT', 'INSERT', 'LWPOLYLINE'][p_partkey % 5 + 1] AS raw_type, 'ok' AS status, 'model' AS space, p_partkey * 200 AS x, CASE WHEN p_partkey % 5 = 4 THEN 3 ELSE 0 END AS c FROM part
      UNION ALL SELECT drawing, 'LAYER', 'layer', NULL, 0, 0 FROM n UNION ALL SELECT drawing, 'CIRCLE', 'ok', 'block', 1, 0 FROM n UNION ALL SELECT drawing, 'LINE', 'ok', 'block', 0, 0 FROM n UNION ALL SELECT drawing, '3DFACE', 'unsupported', NULL, 0, 0 FROM n UNION ALL SELECT drawing, 'LINE', 'ok', 'paper', 0, 0 FROM n)
    SELECT drawing, raw_type, status, space, count(*) AS n, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(c) AS BIGINT) AS corners FROM v GROUP BY ALL""",
    "drawing_layers": f"WITH {_NAMES} SELECT DISTINCT 'd' || p_partkey % 10 AS drawing, CASE WHEN p_partkey % 6 = 0 THEN 'S-BEAM' ELSE 'MISC' END AS layer FROM part UNION SELECT drawing, unnest(['S-BEAM', '0', 'A-BLK', 'PAPER']) FROM n",
    "drawing_unsupported": f"WITH {_NAMES} SELECT drawing, '3DFACE' AS raw_type, 1::BIGINT AS n FROM n",
    "drawing_layout": f"WITH {_NAMES} SELECT drawing, 1::BIGINT AS n, 'PAPER' AS last_layer, 'Sheet 1' AS layout FROM n UNION ALL SELECT 'd' || p_partkey % 10, count(*), max(CASE WHEN p_partkey % 6 = 0 THEN 'S-BEAM' ELSE 'MISC' END), 'Model' FROM part GROUP BY 1",
    "drawing_diff": f"WITH {_DIFF} SELECT drawing, entity_type, layer, change_type, paths, category, count(*) AS n FROM d GROUP BY ALL",
    "drawing_zones": f"""WITH {_DIFF}, z AS (SELECT drawing, count(*) AS n, count(*) FILTER (change_type = 'added') AS a, count(*) FILTER (change_type = 'deleted') AS g, count(*) FILTER (change_type = 'modified') AS m, bool_or(layer = 'S-BEAM') AS st FROM d WHERE change_type <> 'unchanged' GROUP BY drawing, floor(px / 20000), floor(py / 20000)),
    q AS (SELECT *, CASE WHEN n >= 100 OR st THEN 'high' WHEN n >= 10 OR g > 0 OR m > 0 THEN 'medium' ELSE 'low' END AS severity, CASE (a > 0)::INT + (g > 0)::INT + (m > 0)::INT WHEN 1 THEN CASE WHEN a > 0 THEN 'added' WHEN g > 0 THEN 'deleted' ELSE 'modified' END ELSE 'mixed' END AS change_type FROM z)
    SELECT drawing, severity, change_type, count(*) AS zones, CAST(sum(n) AS BIGINT) AS changes FROM q GROUP BY ALL""",
    "change_stream_store": f"WITH {_CHANGES} SELECT pair_id, change_type, layer, count(*) AS n, CAST(sum(round_even(x0, 0)) AS BIGINT) AS x_sum, (SELECT count(*) FROM c WHERE x0 IS NULL) AS without_box FROM c WHERE x0 IS NOT NULL GROUP BY pair_id, change_type, layer",
    "perf_log": "SELECT event_type AS stage, user_id % 2 = 0 AS cache_hit, count(*) AS n, CAST(sum(round_even(value * 100, 0)) AS BIGINT) AS cents FROM events WHERE event_id % 50 <> 0 GROUP BY 1, 2",
    "manual_decisions": "SELECT s_name AS a_path, 'new/' || s_name AS b_path, CASE WHEN s_suppkey % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS status FROM supplier",
    "compare_state": f"WITH {_CHANGES} SELECT pair_id, change_type, entity_type, layer, CAST(round_even(x1, 0) AS BIGINT) AS x1 FROM c WHERE pair_id = 'p7'",
    "overlay_store": "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer WHERE c_nationkey = 5) SELECT c_nationkey, c_custkey, 1::BIGINT AS page FROM r WHERE r // 3 = 1",
    "leak_audit": "WITH v AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'see C:\\x\\' || p_name WHEN 1 THEN 'at /home/u/' || p_name END AS value FROM part) SELECT value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY value",
    "file_listing": f"WITH {_NAMES} SELECT drawing, 'unsupported' AS kind, true AS filled FROM n",
    "result_cache": """WITH c AS (SELECT DISTINCT p_name, p_type FROM part WHERE p_size > 25) SELECT p_partkey, sha256('{"hash_a":"' || md5(p_name) || '"}') AS provenance FROM part p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.p_name = p.p_name AND c.p_type = p.p_type)""",
    "descriptor_cache": """SELECT p_partkey AS "modificationTime", CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 1 THEN 7 END AS entities FROM part""",
    "adapter_scan": "SELECT 'n' || c_nationkey AS drawing, 'mm' AS units, CAST(c_custkey AS VARCHAR) AS id, ['WALL', 'GRID'][c_custkey % 3 + 1] AS layer_name, c_mktsegment AS text FROM customer",
    "zone_files": f"WITH {_ZONES} SELECT CAST(pair_id AS VARCHAR) AS pair_id, zone_id, severity, CAST(n AS VARCHAR) AS raw_change_count, '0.123' AS y0, zone_id AS layers, 'LINE | TEXT' AS entity_types, '' AS status, CAST(round_even(x1, 0) AS BIGINT) AS x1 FROM z",
    "artifact_files": f"WITH {_ZONES} SELECT pair_id, count(*) AS zone_count, count(*) FILTER (n % 3 = 0) AS omitted_count, CAST(sum(n) AS BIGINT) AS raw_change_count, nullif(count(*) FILTER (n % 3 = 0), 0) AS omitted_rows, CASE WHEN count(*) FILTER (n % 3 = 0) > 0 THEN 'max_region_cap' END AS reason FROM z GROUP BY pair_id",
    "result_files": f"WITH {_CHANGES} SELECT change_type, count(*) AS n, count(*) AS report_rows, count(x0) AS boxes FROM c GROUP BY change_type",
    "dashboard_files": "SELECT o_orderkey AS zone_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "cloud_marks": """WITH v AS (SELECT p_partkey AS zone_id, p_size AS w, p_partkey % 9 + 1 AS h FROM part), n AS (SELECT *, greatest(8, CAST(ceil(2 * (w + h) / 5.0::DOUBLE) AS INT)) AS n FROM v), d AS (SELECT *, unnest(range(n)) AS i FROM n), p AS (SELECT zone_id, n, i, 2 * (w + h) * i / CAST(n AS DOUBLE) AS d, w, h FROM d),
    x AS (SELECT zone_id, n, i, CASE WHEN d <= w THEN d WHEN d <= w + h THEN w WHEN d <= 2 * w + h THEN w - (d - w - h) ELSE 0 END AS x FROM p)
    SELECT zone_id, n AS arcs, CAST(round_even(max(x) * 1000, 0) AS BIGINT) AS right_milli, CAST(round_even(max(x) FILTER (i = 1) * 1000, 0) AS BIGINT) AS second_milli FROM x GROUP BY zone_id, n""",
    "curve_geometry": """SELECT p_partkey, 9 AS n_ring, 3000::BIGINT AS ring_top, 9 AS n_flat, CAST(round_even(p_size / 4 * 1000, 0) AS BIGINT) AS flat_x, 0::BIGINT AS back_bulge, -500::BIGINT AS back_bulge_1, CAST(-p_size * 1000 AS BIGINT) AS world_x, -3000::BIGINT AS world_z, 3000::BIGINT AS put_x0, CAST((2 * p_size + 1) * 1000 AS BIGINT) AS put_y1,
      90000::BIGINT AS pixel_x, 10000::BIGINT AS pixel_y, CAST(p_size * 2000 AS BIGINT) AS inch_x, CAST(CASE WHEN p_size - 1.5 > 6 THEN (p_size - 1.5) * 1000 ELSE 0 END AS BIGINT) AS anchor_x, greatest(8, CAST(ceil(2 * (p_size + 1) / 3.0::DOUBLE) AS INT)) AS chords FROM part""",
    "settings_and_keys": """WITH v AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, 0.25::DOUBLE AS rotation, 5.0::DOUBLE AS position, 5.0::DOUBLE AS radius, 'p_partkey' AS key, CAST(round_even(CASE WHEN w[1] = 'red' THEN 1 ELSE 1 / 3 END * 1e6, 0) AS BIGINT) AS likeness_micro FROM v""",
}
