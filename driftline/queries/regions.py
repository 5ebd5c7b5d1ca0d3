"""Frames, blocks, truth, significance and evidence over parts, events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import changes as ch
from driftline.functions import geometry as g
from driftline.functions import keys as k
from driftline.operators import expand, pairing, regions
from driftline.operators import tablediff as td
from driftline.queries.common import table
from driftline.queries.spatial import POINTS, _points


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    wide = (c("p_partkey") % 5 + 1).cast("double")
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("sheet"), g.box(c("p_retailprice"), c("p_size") % 6, c("p_retailprice") + wide, c("p_size") % 6 + 4).alias("box"))


_BOXES = "b AS (SELECT p_partkey AS id, p_brand AS sheet, p_retailprice AS x0, CAST(p_size % 6 AS DOUBLE) AS y0, p_retailprice + p_partkey % 5 + 1 AS x1, p_size % 6 + 4.0::DOUBLE AS y1 FROM part)"


def frame_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.suppressed(_boxes(spark, sf_dir), ["sheet"], 8.0, 0.3).select("id", "sheet")


def frame_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet")).distinct().withColumn("sheet_area", F.lit(1000.0))
    return regions.frames(_boxes(spark, sf_dir), sheets, "sheet").groupBy("sheet").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def outer_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.outer_frame(_boxes(spark, sf_dir), "sheet")


def side_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_size").alias("line"), F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + 1.5).alias("b"))
    out = regions.side_coverage(lines, ["line"], 0.5)
    return out.select("line", "pieces", *[F.rint(F.col(x) * 1000).cast("long").alias(f"{x}_milli") for x in ("covered", "span", "share")])


def cell_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.cell_clusters(_points(spark, sf_dir)[0], ["kind"], 1.0)


def ratio_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.ratio_cut(_boxes(spark, sf_dir), "sheet").groupBy("sheet").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


def vector_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("rev"), (F.col("l_partkey") % 400).alias("page"), F.col("l_quantity").cast("long").alias("path"))
    return regions.set_differences(rows.filter("rev = 0"), rows.filter("rev = 1"), ["page", "path"])


def text_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    return regions.block_pairs(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["sheet"], 8.0, 0.2).select("a_id", "b_id", F.rint(F.col("iou") * 1e6).cast("long").alias("iou_micro"))


def truth_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _points(spark, sf_dir)
    return regions.truth_pairs(b.select("id", "kind", "x", "y"), a.filter("id % 3 = 0").select("id", "kind", "x", "y"), 1.0, ["kind"]).select("truth_id", "predicted_id")


def reorigin_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts spread far apart; in two kinds all have moved by 5000, in one some have gone astray besides."""
    c = F.col
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_type").alias("kind"), (c("p_partkey") * 40.0).alias("x"), (c("p_partkey") % 7 * 100.0).alias("y"))
    shift = F.when(c("kind").isin("ECONOMY", "STANDARD"), 500_000.0).otherwise(0.0)
    new = rows.select("id", "kind", (c("x") + shift + c("id") % 3 * 0.25).alias("x"), "y")
    return regions.reorigin_pairs(rows, new, ["kind"])


def evidence_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _points(spark, sf_dir)
    return regions.nearby(a, a, 2.0, 3, ["kind"]).select("a_id", "b_id", F.col("rank").cast("long").alias("rank"))


CLAUSES = [(1, ["red", "ring"]), (2, ["small"]), (3, ["widget", "blue", "large"]), (4, ["bolt", "green"])]


def clause_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = spark.createDataFrame(CLAUSES, "clause_id long, keywords array<string>")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return regions.lookup(F.broadcast(clauses), rows, 2).select("id", "clause_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def change_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col, ch.Sensitivity()
    kind = F.get(F.array(*map(F.lit, ["LINE", "DIMENSION", "INSERT", "TEXT"])), (c("l_linenumber") % 4).cast("int"))
    layer = F.when(c("l_suppkey") % 3 == 0, "S-BEAM").otherwise("MISC")
    moved = c("l_discount") * 12
    old = {"measure": c("l_quantity"), "rotation": F.lit(359.95), "scale": F.lit(1.0), "content": c("l_returnflag")}
    new = {"measure": c("l_quantity") + c("l_tax") * 20, "rotation": 359.95 + c("l_tax") * 4, "scale": 1 + c("l_discount") / 5, "content": c("l_linestatus")}
    names = ch.categories(s, kind, layer, moved, old, new)
    return table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.array_join(names, ",").alias("categories"), ch.significant(names, moved, s.position_limit(layer)).alias("significant")).groupBy("kind", "categories", "significant").agg(F.count("*").alias("n"))


def alignment_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flag = ch.alignment_artifact(c("l_discount") * 20, c("l_tax") * 20, F.lit(-1.0), F.lit(-1.0), F.lit(0.9), ch.Sensitivity().position_limit(F.when(c("l_suppkey") % 2 == 0, "WALL").otherwise("X")))
    return table(spark, sf_dir, "lineitem").groupBy(flag.alias("artifact"), "l_returnflag").agg(F.count("*").alias("n"))


def line_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    x, y = c("p_retailprice"), c("p_size").cast("double")
    d = ch.line_distance([x, y, y, x], [y + 0.5, x, x, y + c("p_partkey") % 3])
    return table(spark, sf_dir, "part").select("p_partkey", F.rint(d * 1e6).cast("long").alias("move_micro"))


def polyline_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", F.col("l_quantity").alias("x"), F.lit(0.0).alias("y")))).alias("v"))
    other = F.transform("v", lambda p: F.struct((p["x"] + F.when(p["x"] > 40, 2.0).otherwise(0.1)).alias("x"), F.lit(0.0).alias("y")))
    d = ch.polyline_diffs(F.col("v"), other, 1.0)
    return rows.withColumn("d", d).select("l_orderkey", F.col("d.moved").cast("long").alias("moved"), F.rint(F.col("d.farthest") * 10).cast("long").alias("farthest_tenths"))


def domain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["beam B12 at grid-A3", "see section S-201", "NOTE 250 mm", "B-7", "note H400x200 3.5 M"]
    text = F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 5).cast("int"))
    entity, layer = F.when(F.col("p_size") > 40, "dimension").otherwise("TEXT"), F.when(F.col("p_size") < 5, "S-WALL").when(F.col("p_size") < 9, "AXIS-DIM").otherwise("X")
    found = ch.domain_matches(text, entity, layer)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(ch.domain_tags(text, entity, layer), ",").alias("tags"), F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["value"], x["confidence"])), "|").alias("marks"))


def output_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as answers about drawings: some with raw keys, secrets, words of action, or calm words about a failed source."""
    c = F.col
    health = F.get(F.array(F.lit("ok"), F.lit("Failed"), F.lit("partial")), (c("p_partkey") % 3).cast("int"))
    answer = F.concat("p_name", F.when(c("p_size") % 4 == 0, " is Approved and can proceed").when(c("p_size") % 4 == 1, ": no issues found").otherwise(""))
    draft = F.struct(F.lit("note").alias("subject"), F.when(c("p_size") % 6 == 0, "token = abcdefgh12").otherwise("body").alias("body"))
    raw = F.when(c("p_size") % 5 == 0, F.lit("{}"))
    payload = F.to_json(F.struct(F.struct(answer.alias("answer")).alias("summary"), draft.alias("draft"), F.struct(health.alias("source_health")).alias("basis"), raw.alias("Raw_Entities")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(ch.safety_findings(payload), ",").alias("findings"))


def quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", ch.quality_tier(c("p_size") * 10.0, c("p_partkey") % 50, c("p_retailprice")).alias("t")).select("p_partkey", "t.dpi", "t.max_edge_px", "t.fits")


def zone_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = F.when(c("l_returnflag") == "A", "added").when(c("l_returnflag") == "R", "deleted").otherwise("modified")
    before, after = F.when(c("l_suppkey") % 3 > 0, c("l_suppkey")), F.when(c("l_partkey") % 4 > 0, c("l_partkey"))
    match = F.when(c("l_linenumber") % 3 == 0, "review_required").when(c("l_linenumber") % 3 == 1, "auto")
    return table(spark, sf_dir, "lineitem").groupBy(ch.localised_status(kind, before, after, match).alias("status")).agg(F.count("*").alias("n"))


def layout_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired, deleted and added rows by layout: the layout is one more key."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("layout"), "l_returnflag", F.col("l_quantity").cast("long").alias("qty"), "l_orderkey")
    n = td.multiset_counts(rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1"), ["layout", "l_returnflag", "qty"])
    return n.groupBy("layout").agg(*[F.sum(x).alias(x) for x in ("n_paired", "n_deleted", "n_added")])


def duplicate_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed diff when keys repeat: the first row of a key counts on either side; texts differ only beyond commas and blanks."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(c("l_returnflag"), F.lit(", "), c("l_linestatus")).alias("mark"), "l_tax")
    old = td.first_of_key(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "mark", "l_tax"])
    new = td.first_of_key(rows.filter("l_linenumber > 1"), ["l_orderkey"], ["l_linenumber", "l_partkey", "mark", "l_tax"]).withColumn("mark", F.regexp_replace("mark", ", ", ""))
    return td.keyed_diff(old, new, ["l_orderkey"], ["mark", "l_tax"]).groupBy("change_type", "column_name").agg(F.count("*").alias("n"))


def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts, drawn as entities of several kinds, share a key with another."""
    c = F.col
    kind = F.get(F.array(*map(F.lit, ["line", "circle", "arc", "polyline", "text", "insert", "point"])), (c("p_partkey") % 7).cast("int"))
    x, y = (c("p_size") % 10).cast("double"), (c("p_partkey") % 3).cast("double")
    v = F.array(*[F.struct(p.cast("double").alias("x"), q.cast("double").alias("y")) for p, q in ((x, y), (y, x), (x + 1, y))])
    e = {"x": x, "y": y, "x2": y, "y2": x, "radius": y + 1, "angle": x * 90, "angle2": y * 360, "text": c("p_type"), "name": c("p_brand"), "sx": F.lit(1.0), "sy": y, "vertices": v, "closed": c("p_size") % 2 == 0}
    rows = table(spark, sf_dir, "part").select(kind.alias("kind"), k.entity_key(kind, e).alias("key"))
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count("*").alias("keys"), F.max("n").alias("most"))


def layer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    names = ["S-BEAM", "A-TEXT", "TEMP-1", "DEFPOINTS", "TITLE", "Wall", "XREF"]
    layer = F.get(F.array(*map(F.lit, names)), (c("p_partkey") % 7).cast("int"))
    rows = table(spark, sf_dir, "part").select(layer.alias("layer"))
    priority = k.layer_priority(c("layer"), [(-1, ["DEFPOINTS", "*TEMP*"]), (2, ["*BEAM*", "*WALL*"]), (0, ["*TEXT*"])])
    return rows.groupBy("layer", priority.cast("long").alias("priority"), k.change_ignored(c("layer"), ["xref"], ["temp*"]).alias("ignored")).agg(F.count("*").alias("n"))


def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = g.box(F.lit(910.0), F.lit(1.0), F.lit(960.0), F.lit(8.0))
    rows = _boxes(spark, sf_dir)
    return rows.groupBy("sheet").agg(F.count_if(k.in_region(F.col("box"), region, "contained")).alias("contained"), F.count_if(k.in_region(F.col("box"), region, "intersecting")).alias("intersecting"))


def table_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as regions, parts as their entities: counts of each region, and why it is rejected."""
    c = F.col
    layer = F.get(F.array(*map(F.lit, ["S-BEAM", "PARTS-BOM", "X", "GRID-REV", "0"])), (c("p_partkey") % 5).cast("int"))
    entity = F.get(F.array(*map(F.lit, ["LINE", "TEXT", "CIRCLE", "INSERT"])), (c("p_size") % 4).cast("int"))
    named = k.table_word(F.when(layer == "PARTS-BOM", "X").otherwise(layer), c("p_name"), F.lit(""))
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", (c("p_partkey") % 3).cast("string")).alias("region"), entity.alias("entity"), k.looks_structural(layer, entity).alias("structural"), (named & (c("p_partkey") % 2 == 0)).alias("named"), F.when(c("p_size") % 4 == 1, c("p_name")).alias("text"), "p_partkey")
    counts = rows.groupBy("region").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.count_if(c("entity").isin(*k.LINES)).alias("n_line"), F.count_if("structural").alias("n_structural"), F.bool_or("named").alias("named"), (F.max("p_partkey") % 20).alias("area"))
    reasons = k.table_reasons(c("n"), c("n_text"), c("n_line"), c("n_structural"), c("named"), c("area"), F.lit(100))
    return counts.select("region", "n_structural", "named", F.array_join(reasons, ",").alias("reasons"))


def attribute_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the coordinates of a parent that is shifted, turned by quarters and mirrored."""
    c = F.col
    p = k.local_place(c("p_retailprice"), c("p_size").cast("double"), F.lit(900.0), F.lit(10.0), F.lit(2.0), F.lit(-1.0), (c("p_partkey") % 4) * 90.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.rint(p["x"] * 1000).cast("long").alias("x_milli"), F.rint(p["y"] * 1000).cast("long").alias("y_milli"))


def classifier_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    second, sure = F.when(c("p_size") % 3 > 0, F.lit("grid")), (c("p_size") % 10) / 10
    rows = table(spark, sf_dir, "part").select(k.cascade(F.lit("other"), second, sure, 0.5).alias("category"), k.needs_review(F.when(second.isNull(), "heuristic").otherwise("embedding"), sure).alias("review"))
    return rows.groupBy("category", "review").agg(F.count("*").alias("n"))


def override_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    files = table(spark, sf_dir, "supplier").select(c("s_name").alias("path"), F.when(c("s_suppkey") % 2 == 0, "cad").otherwise("pdf").alias("kind"))
    status = F.when(c("s_suppkey") % 5 == 0, "rejected").when(c("s_suppkey") % 7 == 0, "maybe").otherwise("confirmed")
    rows = table(spark, sf_dir, "supplier").select(c("s_name").alias("a_path"), F.format_string("Supplier#%09d", (c("s_suppkey") * 2) % 130).alias("b_path"), status.alias("status"), c("s_suppkey").alias("ordinal"))
    return pairing.checked_overrides(rows, files).select("ordinal", "error")


def best_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    drawings = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), c("s_nationkey").alias("set_id"))
    pages = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("set_id"), c("c_custkey").alias("page"))
    scores = expand.many_with_many(drawings.filter("id % 3 > 0"), pages, "set_id", "page").select("id", "page", (c("page") * 7 % 11).alias("score"))
    return pairing.best_page(drawings, pages, scores)


QUERIES = {
    f.__name__: f
    for f in (
        frame_suppression, frame_candidates, outer_frames, side_coverage, cell_clusters, ratio_cut, vector_set_diff, text_block_pairs, truth_matching, reorigin_recovery, evidence_nearby, clause_lookup, change_categories,
        alignment_artifacts, line_moves, polyline_moves, domain_tags, output_safety, quality_tiers, zone_localisation, layout_diff, duplicate_key_diff, entity_keys, layer_filters,
        region_filter, table_rejection, attribute_places, classifier_cascade, override_errors, best_pages,
    )
}

_LINES = "CASE l_linenumber % 4 WHEN 0 THEN 'LINE' WHEN 1 THEN 'DIMENSION' WHEN 2 THEN 'INSERT' ELSE 'TEXT' END"

ORACLE_SQL = {
    "frame_candidates": f"WITH {_BOXES} SELECT sheet, count(*) AS n, min(id) AS first_id FROM b WHERE (x1 - x0) * (y1 - y0) >= 0.01::DOUBLE * 1000 GROUP BY sheet",
    "outer_frames": f"WITH {_BOXES} SELECT sheet, id FROM b QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY (x1 - x0) * (y1 - y0) DESC, id) = 1",
    "side_coverage": """WITH v AS (SELECT p_size AS line, p_retailprice AS a, p_retailprice + 1.5 AS b FROM part), r AS (SELECT *, max(b) OVER (PARTITION BY line ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r), m AS (SELECT line, k, min(a) AS s, max(b) AS e FROM i GROUP BY ALL)
    SELECT line, count(*) AS pieces, CAST(round_even(sum(e - s) * 1000, 0) AS BIGINT) AS covered_milli, CAST(round_even((max(e) - min(s)) * 1000, 0) AS BIGINT) AS span_milli, CAST(round_even(sum(e - s) / (max(e) - min(s)) * 1000, 0) AS BIGINT) AS share_milli FROM m GROUP BY line""",
    "cell_clusters": f"""WITH RECURSIVE {POINTS}, q AS (SELECT *, floor(x) AS gx, floor(y) AS gy FROM a),
    e AS (SELECT DISTINCT u.id AS u, v.id AS v FROM q u JOIN q v ON u.kind = v.kind AND abs(u.gx - v.gx) <= 1 AND abs(u.gy - v.gy) <= 1), r AS (SELECT id AS node, id AS seen FROM q UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u)
    SELECT kind, node AS id, min(seen) AS cluster FROM r JOIN q ON q.id = node GROUP BY kind, node""",
    "vector_set_diff": """WITH r AS (SELECT DISTINCT l_orderkey % 2 AS rev, l_partkey % 400 AS page, CAST(l_quantity AS BIGINT) AS path FROM lineitem)
    SELECT page, path, 'removed' AS side FROM (SELECT page, path FROM r WHERE rev = 0 EXCEPT SELECT page, path FROM r WHERE rev = 1) UNION ALL SELECT page, path, 'added' FROM (SELECT page, path FROM r WHERE rev = 1 EXCEPT SELECT page, path FROM r WHERE rev = 0)""",
    "reorigin_recovery": "SELECT p_type AS kind, p_partkey AS a_id, p_partkey AS b_id FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')",
    "evidence_nearby": f"""WITH {POINTS}, d AS (SELECT u.id AS a_id, v.id AS b_id, sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) AS d FROM a u JOIN a v ON u.kind = v.kind AND u.id <> v.id AND abs(u.x - v.x) <= 2)
    SELECT a_id, b_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS r FROM d WHERE d <= 2) WHERE r <= 3""",
    "clause_lookup": """WITH k AS (SELECT * FROM (VALUES (1, 'red'), (1, 'ring'), (2, 'small'), (3, 'widget'), (3, 'blue'), (3, 'large'), (4, 'bolt'), (4, 'green')) t(clause_id, w)),
    s AS (SELECT p_partkey AS id, clause_id, CAST(sum(length(w)) AS BIGINT) AS score FROM part, k WHERE contains(lower(p_name), w) GROUP BY ALL)
    SELECT id, CAST(clause_id AS BIGINT) AS clause_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, clause_id) AS rank FROM s QUALIFY rank <= 2""",
    "change_categories": f"""WITH v AS (SELECT {_LINES} AS kind, l_discount * 12 AS moved, CASE WHEN l_suppkey % 3 = 0 THEN 0.1::DOUBLE ELSE 1 END AS lim, abs((l_quantity + l_tax * 20) - l_quantity) AS dm, l_quantity AS q, abs((359.95::DOUBLE + l_tax * 4) - 359.95::DOUBLE) AS r, abs(1 + l_discount / 5 - 1) AS sc, l_returnflag <> l_linestatus AS c FROM lineitem),
    n AS (SELECT kind, moved, lim, list_filter([CASE WHEN moved >= lim THEN 'position' END, CASE WHEN kind = 'DIMENSION' AND (dm >= 1 OR dm / q >= 0.001::DOUBLE) THEN 'dimension' END, CASE WHEN least(r, 360 - r) >= 0.1::DOUBLE THEN 'rotation' END,
      CASE WHEN kind = 'INSERT' AND sc >= 0.01::DOUBLE THEN 'scale' END, CASE WHEN kind IN ('TEXT', 'INSERT') AND c THEN 'content' END], lambda x: x IS NOT NULL) AS f FROM v)
    SELECT kind, CASE WHEN len(f) = 0 THEN 'content' ELSE array_to_string(f, ',') END AS categories, NOT (f = ['position'] AND moved < lim) AS significant, count(*) AS n FROM n GROUP BY ALL""",
    "alignment_artifacts": """WITH v AS (SELECT l_returnflag, CASE WHEN l_suppkey % 2 = 0 THEN 0.1::DOUBLE ELSE 1 END AS t, l_discount * 20 - 1 AS dx, l_tax * 20 - 1 AS dy FROM lineitem) SELECT abs(dx) < t AND abs(dy) < t AS artifact, l_returnflag, count(*) AS n FROM v GROUP BY ALL""",
    "line_moves": """WITH v AS (SELECT p_partkey, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, p_partkey % 3 AS k FROM part), d AS (SELECT p_partkey, greatest(sqrt((x - y - 0.5) ** 2 + (y - x) ** 2), sqrt((y - x) ** 2 + (x - y - k) ** 2)) AS a, greatest(CAST(k AS DOUBLE), 0.5::DOUBLE) AS b FROM v)
    SELECT p_partkey, CAST(round_even(least(a, b) * 1e6, 0) AS BIGINT) AS move_micro FROM d""",
    "polyline_moves": """WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity AS x FROM lineitem) SELECT l_orderkey, count(*) FILTER (x > 40) AS moved, CAST(CASE WHEN max(x) > 40 THEN 20 ELSE 1 END AS BIGINT) AS farthest_tenths FROM v GROUP BY l_orderkey""",
    "domain_tags": """WITH v AS (SELECT p_partkey, p_size, p_partkey % 5 AS t, ['beam B12 at grid-A3', 'see section S-201', 'NOTE 250 mm', 'B-7', 'note H400x200 3.5 M'][p_partkey % 5 + 1] AS text, p_size > 40 AS d, p_size BETWEEN 5 AND 8 AS g, p_size < 5 AS w FROM part),
    m AS (SELECT p_partkey, list_filter([CASE WHEN t = 0 THEN 'grid:grid-A3:high' END, CASE WHEN g AND t = 3 THEN 'grid:B-7:medium' END, CASE t WHEN 0 THEN 'member_tag:beam B12:high' WHEN 3 THEN 'member_tag:B-7:high' WHEN 4 THEN 'member_tag:H400x200:high' END, CASE WHEN t = 1 THEN 'section_reference:section:high' END,
      CASE WHEN t = 1 THEN 'section_reference:S-201:high' END, CASE WHEN t = 2 THEN 'note:NOTE:medium' END, CASE WHEN d THEN 'dimension:' || text || ':high' END, CASE WHEN g AND NOT d THEN CASE t WHEN 2 THEN 'dimension:250 mm:medium' WHEN 3 THEN 'dimension:7:medium' WHEN 4 THEN 'dimension:3.5 M:medium' WHEN 1 THEN 'dimension:201:medium' END END,
      CASE WHEN w THEN 'structural_layer:S-WALL:medium' WHEN g THEN 'structural_layer:AXIS-DIM:medium' END], lambda x: x IS NOT NULL) AS m FROM v)
    SELECT p_partkey, array_to_string(list_filter(['grid', 'member_tag', 'section_reference', 'note', 'dimension', 'structural_layer'], lambda k: len(list_filter(m, lambda x: starts_with(x, k || ':'))) > 0), ',') AS tags, array_to_string(m, '|') AS marks FROM m""",
    "output_safety": """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 5 = 0 THEN 'raw_payload_key' END, CASE WHEN p_size % 6 = 0 THEN 'secret_like_marker' END, CASE WHEN p_size % 4 = 0 THEN 'positive_action_language' END, CASE WHEN p_size % 4 = 0 THEN 'positive_action_language' END,
      CASE WHEN p_size % 4 = 1 AND p_partkey % 3 > 0 THEN 'source_health_misleading_answer' END], lambda x: x IS NOT NULL), ',') AS findings FROM part""",
    "quality_tiers": """WITH v AS (SELECT p_partkey, CASE WHEN p_size * 10 <= 25 THEN 1.0::DOUBLE WHEN p_size * 10 <= 100 THEN 1.5 WHEN p_size * 10 <= 300 THEN 2.5 ELSE 4 END * (1 + p_partkey % 50 / 100) AS l, p_retailprice * 0.6::DOUBLE AS b FROM part)
    SELECT p_partkey, CASE WHEN l * 1100 <= b THEN 300 WHEN l * 600 <= b THEN 200 WHEN l * 250 <= b THEN 120 ELSE 80 END AS dpi, CASE WHEN l * 1100 <= b THEN 8000 WHEN l * 600 <= b THEN 6000 WHEN l * 250 <= b THEN 3600 ELSE 2400 END AS max_edge_px, l * 120 <= b AS fits FROM v""",
    "zone_localisation": """WITH v AS (SELECT l_returnflag AS k, l_suppkey % 3 > 0 AS b, l_partkey % 4 > 0 AS a, l_linenumber % 3 AS m FROM lineitem)
    SELECT CASE WHEN k = 'A' THEN CASE WHEN a THEN 'added_in_after_region' ELSE 'unassigned' END WHEN k = 'R' THEN CASE WHEN b THEN 'deleted_from_before_region' ELSE 'unassigned' END WHEN a AND b AND m = 0 THEN 'matched_region_review_required' WHEN a AND b AND m = 1 THEN 'matched_region_change'
      WHEN a AND b THEN 'cross_region_or_unmatched_detail' WHEN b THEN 'before_region_only' WHEN a THEN 'after_region_only' ELSE 'unassigned' END AS status, count(*) AS n FROM v GROUP BY 1""",
    "layout_diff": """WITH n AS (SELECT l_linestatus AS layout, l_returnflag, CAST(l_quantity AS BIGINT) AS q, count(*) FILTER (l_orderkey % 2 = 0) AS a, count(*) FILTER (l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY ALL)
    SELECT layout, CAST(sum(least(a, b)) AS BIGINT) AS n_paired, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS n_deleted, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS n_added FROM n GROUP BY layout""",
    "duplicate_key_diff": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus AS mark, l_returnflag || ', ' || l_linestatus AS m0, l_tax FROM lineitem),
    o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, m0, l_tax) = 1), n AS (SELECT * FROM r WHERE l_linenumber > 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, m0, l_tax) = 1),
    j AS (SELECT o.l_orderkey AS ok, n.l_orderkey AS nk, o.mark AS om, n.mark AS nm, o.l_tax AS ot, n.l_tax AS nt FROM o FULL JOIN n USING (l_orderkey)),
    c AS (SELECT CASE WHEN ok IS NULL THEN 'ADDED' ELSE 'DELETED' END AS change_type, NULL::VARCHAR AS column_name FROM j WHERE ok IS NULL OR nk IS NULL UNION ALL SELECT 'MODIFIED', 'mark' FROM j WHERE om <> nm UNION ALL SELECT 'MODIFIED', 'l_tax' FROM j WHERE abs(ot - nt) > 0.001::DOUBLE)
    SELECT change_type, column_name, count(*) AS n FROM c GROUP BY ALL""",
    "entity_keys": """WITH v AS (SELECT p_partkey % 7 AS t, p_size % 10 AS x, p_partkey % 3 AS y, p_type, p_brand, p_size % 2 = 0 AS c FROM part),
    w AS (SELECT t, CASE t WHEN 0 THEN least(x, y) || ',' || greatest(x, y) WHEN 1 THEN x || ',' || y WHEN 2 THEN x || ',' || y || ',' || (x * 90 % 360) WHEN 3 THEN x || ',' || y || ',' || c WHEN 4 THEN x || ',' || y || p_type WHEN 5 THEN x || ',' || y || p_brand || (x * 90 % 360) ELSE x || ',' || y END AS k FROM v)
    SELECT ['line', 'circle', 'arc', 'polyline', 'text', 'insert', 'point'][t + 1] AS kind, count(*) AS keys, max(n) AS most FROM (SELECT t, k, count(*) AS n FROM w GROUP BY ALL) GROUP BY t""",
    "layer_filters": """WITH v AS (SELECT p_partkey % 7 AS t FROM part) SELECT ['S-BEAM', 'A-TEXT', 'TEMP-1', 'DEFPOINTS', 'TITLE', 'Wall', 'XREF'][t + 1] AS layer, [2, 0, -1, -1, 1, 2, 1][t + 1]::BIGINT AS priority, t IN (2, 4, 6) AS ignored, count(*) AS n FROM v GROUP BY t""",
    "region_filter": f"WITH {_BOXES} SELECT sheet, count(*) FILTER (x0 >= 910 AND x1 <= 960 AND y0 >= 1 AND y1 <= 8) AS contained, count(*) FILTER (x0 <= 960 AND x1 >= 910 AND y0 <= 8 AND y1 >= 1) AS intersecting FROM b GROUP BY sheet",
    "table_rejection": """WITH v AS (SELECT p_brand || '/' || p_partkey % 3 AS region, p_partkey, p_partkey % 5 AS l, p_size % 4 AS e, p_name FROM part),
    c AS (SELECT region, count(*) AS n, count(*) FILTER (e = 1) AS t, count(*) FILTER (e = 0) AS r, count(*) FILTER (e <> 1 AND l NOT IN (1, 3) AND (l = 0 OR e IN (0, 2))) AS s, bool_or(p_partkey % 2 = 0 AND l = 3) AS k, max(p_partkey) % 20 AS area FROM v GROUP BY region),
    f AS (SELECT *, area <= 8 AS small, t >= greatest(4, floor(n * 0.35::DOUBLE)) AS heavy, r >= 6 AND s <= greatest(2, floor(n * 0.20::DOUBLE)) AS ruled FROM c),
    j AS (SELECT *, NOT (s >= greatest(10, floor(n * 0.35::DOUBLE)) AND NOT heavy AND NOT ruled) AND ((k AND (small OR heavy OR ruled)) OR (small AND heavy AND ruled)) AS rejected FROM f)
    SELECT region, s AS n_structural, k AS named, CASE WHEN rejected THEN array_to_string(list_filter([CASE WHEN k THEN 'table keyword' END, CASE WHEN small THEN 'small relative area' END, CASE WHEN heavy THEN 'text heavy' END, CASE WHEN ruled THEN 'grid-like table' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS reasons FROM j""",
    "attribute_places": """WITH v AS (SELECT p_partkey, p_retailprice - 900 AS dx, p_size - 10.0::DOUBLE AS dy, radians((p_partkey % 4) * 90) AS a FROM part)
    SELECT p_partkey, CAST(round_even((dx * cos(a) + dy * sin(a)) / 2 * 1000, 0) AS BIGINT) AS x_milli, CAST(round_even(-(dy * cos(a) - dx * sin(a)) * 1000, 0) AS BIGINT) AS y_milli FROM v""",
    "classifier_cascade": """WITH v AS (SELECT p_size % 3 > 0 AS s, p_size % 10 AS c FROM part) SELECT CASE WHEN s AND c >= 5 THEN 'grid' ELSE 'other' END AS category, NOT s OR c < 6 AS review, count(*) AS n FROM v GROUP BY ALL""",
    "override_errors": """WITH v AS (SELECT s_suppkey AS o, s_suppkey AS a, s_suppkey * 2 % 130 AS b, CASE WHEN s_suppkey % 5 = 0 THEN 'rejected' WHEN s_suppkey % 7 = 0 THEN 'maybe' ELSE 'confirmed' END AS st FROM supplier),
    e AS (SELECT v.*, CASE WHEN st = 'maybe' THEN 'unknown status' WHEN t.s_suppkey IS NULL THEN 'missing path' WHEN a % 2 <> b % 2 THEN 'incompatible kinds' END AS base FROM v LEFT JOIN supplier t ON t.s_suppkey = b),
    f AS (SELECT *, row_number() OVER (PARTITION BY b, base IS NULL AND st = 'confirmed' ORDER BY o) AS r FROM e)
    SELECT o AS ordinal, coalesce(base, CASE WHEN st = 'confirmed' AND r > 1 THEN 'conflicting pair' END) AS error FROM f""",
    "best_pages": """WITH d AS (SELECT s_suppkey AS id, s_nationkey AS s FROM supplier), p AS (SELECT c_nationkey AS s, c_custkey AS page FROM customer), n AS (SELECT s, count(*) AS n, min(page) AS only_page FROM p GROUP BY s),
    b AS (SELECT id, page FROM d JOIN p USING (s) WHERE id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY page * 7 % 11 DESC, page) = 1)
    SELECT id, CASE WHEN n = 1 THEN only_page ELSE coalesce(page, 0) END AS page, CASE WHEN n = 1 THEN 'single' WHEN page IS NOT NULL THEN 'matched' ELSE 'fallback' END AS source FROM d LEFT JOIN n USING (s) LEFT JOIN b USING (id)""",
}
