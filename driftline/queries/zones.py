"""Clusters of changes over events, parts and lineitem, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import classify
from driftline.functions import geometry as g
from driftline.operators import zones
from driftline.queries.common import table


#: Milliseconds since 1970 of a timestamp with or without zone.
MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(MILLIS).alias("ms"), "value")


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zones.islands(_events(spark, sf_dir), ["user_id"], F.col("ms"), F.col("ms") + 1000, 600_000, ["event_id"])
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")).withColumn("island", F.col("island").cast("long"))


def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = zones.merged_intervals(_events(spark, sf_dir), ["event_type"], F.col("ms"), F.col("ms") + (F.col("value") * 1000).cast("long"), 0.0, ["event_id"])
    return zones.coverage(merged, ["event_type"], F.lit(1704067200000.0), F.lit(1704153600000.0)).select("event_type", "n_intervals", F.rint(F.col("coverage") * 1e6).cast("long").alias("coverage_micro"))


def zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts by type, linked over small gaps."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), g.box(F.col("p_retailprice"), F.col("p_size"), F.col("p_retailprice") + 0.4, F.col("p_size") + 0.4).alias("box"))
    return zones.clusters(part, 0.4, 2.0, ["kind"])


def mega_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "event_type", (F.col("ms") / 60000).alias("x"), F.col("value").alias("y"))
    return zones.split_mega(rows, "event_type", ["event_id"], most=500, span=100.0, grid=500.0, chunk=40).select("event_id", F.col("cell_x").cast("long").alias("cell_x"), F.col("cell_y").cast("long").alias("cell_y"), F.col("part").cast("long").alias("part"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as changes: kind by return flag, entity by quantity, layer by supplier, box by price and quantity."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") % 500).alias("pair_id"), c("l_orderkey").alias("zone_id"), c("l_linenumber").alias("line"), F.when(c("l_returnflag") == "A", "added").when(c("l_returnflag") == "R", "deleted").otherwise("modified").alias("change_type"),
        F.when(c("l_quantity") > 48, "DIMENSION").when(c("l_quantity") > 30, "LINE").otherwise("TEXT").alias("entity_type"),
        F.concat(F.when(c("l_suppkey") % 11 == 0, "S-BEAM").when(c("l_suppkey") % 7 == 0, "A-TEXT").otherwise("MISC"), (c("l_suppkey") % 4).cast("string")).alias("layer"),
        c("l_extendedprice").alias("x0"), c("l_quantity").alias("y0"), (c("l_extendedprice") + 10).alias("x1"), (c("l_quantity") + 1).alias("y1"),
        (c("l_discount") > 0.03).alias("moved"), F.when(c("l_tax") > 0.06, "position,text").when(c("l_tax") > 0.03, " Position").otherwise("").alias("category"),
    )


CHANGES = """c AS (SELECT l_orderkey % 500 AS pair_id, l_orderkey AS zone_id, l_linenumber AS line, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change_type,
  CASE WHEN l_quantity > 48 THEN 'DIMENSION' WHEN l_quantity > 30 THEN 'LINE' ELSE 'TEXT' END AS entity_type,
  CASE WHEN l_suppkey % 11 = 0 THEN 'S-BEAM' WHEN l_suppkey % 7 = 0 THEN 'A-TEXT' ELSE 'MISC' END || CAST(l_suppkey % 4 AS VARCHAR) AS layer,
  l_extendedprice AS x0, l_quantity AS y0, l_extendedprice + 10 AS x1, l_quantity + 1 AS y1, l_discount > 0.03::DOUBLE AS moved, l_tax > 0.06::DOUBLE AS reworded FROM lineitem),
z AS (SELECT pair_id, zone_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n, count(*) FILTER (change_type = 'added') AS n_added, count(*) FILTER (change_type = 'deleted') AS n_deleted,
  count(*) FILTER (change_type = 'modified') AS n_modified, count(*) FILTER (entity_type = 'DIMENSION') AS n_dimension, bool_or(layer LIKE 'S-BEAM%') AS structural, count(DISTINCT layer) AS n_layers, bool_or(moved) AND count(*) FILTER (change_type = 'modified') > 0 AS shifted, bool_and(entity_type <> 'LINE') AND NOT bool_or(layer LIKE 'S-BEAM%') AND NOT bool_or(reworded) AS notes FROM c GROUP BY ALL),
s AS (SELECT * EXCLUDE (shifted, notes), CASE WHEN shifted AND notes THEN 'annotation reposition' WHEN n_dimension > 0 THEN 'contains dimension changes' WHEN structural THEN 'contains structural layer changes' WHEN n >= 100 THEN 'large clustered change' ELSE '' END AS reason,
  CASE WHEN shifted AND notes THEN 'low' WHEN n_dimension > 0 THEN 'critical' WHEN n >= 100 OR structural THEN 'high' WHEN n >= 10 OR n_deleted > 0 OR n_modified > 0 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN shifted THEN 'moved' ELSE CASE (n_added > 0)::INT + (n_deleted > 0)::INT + (n_modified > 0)::INT WHEN 1 THEN CASE WHEN n_added > 0 THEN 'added' WHEN n_deleted > 0 THEN 'deleted' ELSE 'modified' END ELSE 'mixed' END END AS change_type FROM z)"""


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.summaries(_changes(spark, sf_dir), ["pair_id", "zone_id"])


def zone_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zones(spark, sf_dir)


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type and layer, by type, by layer and in all, in one pass."""
    return _changes(spark, sf_dir).groupingSets([["entity_type", "layer", "change_type"], ["entity_type", "change_type"], ["layer", "change_type"], ["change_type"], []], "entity_type", "layer", "change_type").agg(F.count("*").alias("n"))


def layer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["added", "deleted", "modified"]
    rows = _changes(spark, sf_dir)
    first = F.min_by("entity_type", F.struct("zone_id", "line", "x0", "y0", "entity_type")).alias("first_entity")
    return rows.groupBy("layer").agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in kinds], F.count("*").alias("total"), first)


def top_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.top_values(_changes(spark, sf_dir), ["pair_id"], "layer", 4, "top_layers")


def text_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.first_values(_changes(spark, sf_dir), ["pair_id"], "layer", ["zone_id", "line"], 3, "evidence")


def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per drawing: zones, changes, severities (critical counts apart) and top layers."""
    level = lambda k: F.count_if(F.col("severity") == k).alias(k)
    agg = _zones(spark, sf_dir).groupBy("pair_id").agg(F.count("*").alias("zones"), F.sum("n").alias("changes"), level("critical"), level("high"), level("medium"), level("low"))
    return agg.join(top_layers(spark, sf_dir), "pair_id")


def repeated_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("layer").agg(F.count_distinct("zone_id").alias("zones"), F.count("*").alias("changes"), F.count_distinct("pair_id").alias("drawings"))


def cloud_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of a drawing as one region: box of all, worst severity, one kind or mixed, source zones."""
    rank = classify.lookup(F.col("severity"), {k: float(v) for k, v in zones.RANK.items()}, 0.0)
    agg = _zones(spark, sf_dir).groupBy("pair_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"), F.max_by("severity", rank).alias("severity"),
        F.when(F.count_distinct("change_type") == 1, F.min("change_type")).otherwise("mixed").alias("change_type"), F.min("zone_id").alias("first_zone"), F.count("*").alias("zones"),
    )
    return agg


def _sized_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zones(spark, sf_dir).select(F.col("zone_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "n_added", "n_deleted", "change_type")


def relocation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order and flag as zones, linked one to one."""
    return zones.relocations(_sized_zones(spark, sf_dir)).select("a_id", "b_id", "n")


def relocation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.relocation_candidates(_sized_zones(spark, sf_dir)).select("a_id", "b_id", "n", F.rint(F.col("size_diff") * 1000).cast("long").alias("size_diff_milli"), F.rint(F.col("dx") * 1000).cast("long").alias("dx_milli"))


def folded_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zones.folded(_zones(spark, sf_dir), ["change_type", "severity", "n_layers"], ["pair_id", "zone_id"])
    return rows.select("zone_id", "members", F.col("place").cast("long").alias("place"), "is_folded")


def capped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _zones(spark, sf_dir).select("pair_id", F.col("zone_id").alias("id"), "n", "severity")
    return zones.capped(z, "pair_id", [F.desc("n"), F.col("id")], 5, 300, F.col("severity") != "low").select("pair_id", "id", "reason")


def noise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir).groupBy("zone_id").agg(F.count("*").alias("n"), F.bool_and(F.col("entity_type") == "TEXT").alias("cosmetic"), F.bool_and(F.col("y0") < 10).alias("micro"), F.bool_or(F.col("layer").startswith("S-BEAM")).alias("structural"))
    return rows.select("zone_id", F.rint(classify.noise_score(F.col("n"), F.col("cosmetic"), F.col("micro"), F.col("structural")) * 10).cast("long").alias("noise_tenths"))


QUERIES = {
    f.__name__: f
    for f in (
        event_islands, coverage_islands, zone_clusters, mega_split, zone_severity, change_counts, layer_statistics, top_layers, text_evidence, executive_summary, repeated_layers,
        cloud_regions, relocation_pairs, relocation_links, folded_zones, capped_regions, noise_scores,
    )
}

_EVENTS = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, value FROM events)"
_TOP = "string_agg(layer, ', ' ORDER BY r)"
_TOP_LAYERS = f"t AS (SELECT pair_id, {_TOP} AS top_layers FROM (SELECT pair_id, layer, row_number() OVER (PARTITION BY pair_id ORDER BY count(*) DESC, layer) AS r FROM c GROUP BY pair_id, layer) WHERE r <= 4 GROUP BY pair_id)"

ORACLE_SQL = {
    "event_islands": f"""WITH {_EVENTS}, r AS (SELECT *, max(ms + 1000) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR ms > reach + 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM i GROUP BY user_id, island""",
    "coverage_islands": f"""WITH {_EVENTS}, v AS (SELECT *, ms + CAST(trunc(value * 1000) AS BIGINT) AS stop FROM e),
    r AS (SELECT *, max(stop) OVER (PARTITION BY event_type ORDER BY ms, stop, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ms, stop, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r),
    m AS (SELECT event_type, island, min(ms) AS a, max(stop) AS b FROM i GROUP BY ALL)
    SELECT event_type, count(*) AS n_intervals, CAST(round_even(sum(greatest(least(b, 1704153600000.0::DOUBLE) - greatest(a, 1704067200000.0::DOUBLE), 0)) / 86400000.0::DOUBLE * 1e6, 0) AS BIGINT) AS coverage_micro FROM m GROUP BY event_type""",
    "zone_clusters": """WITH RECURSIVE b AS (SELECT p_partkey AS id, p_type AS kind, p_retailprice AS x0, p_size AS y0, p_retailprice + 0.4::DOUBLE AS x1, p_size + 0.4::DOUBLE AS y1 FROM part),
    d AS (SELECT a.id AS u, b.id AS v, greatest(a.x0 - b.x1, b.x0 - a.x1, 0) AS dx, greatest(a.y0 - b.y1, b.y0 - a.y1, 0) AS dy FROM b a JOIN b USING (kind) WHERE abs(a.x0 - b.x0) <= 1),
    e AS (SELECT u, v FROM d WHERE sqrt(dx * dx + dy * dy) <= 0.4::DOUBLE),
    r AS (SELECT id AS node, id AS seen FROM b UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u)
    SELECT kind, node AS id, min(seen) AS zone FROM r JOIN b ON b.id = node GROUP BY kind, node""",
    "mega_split": f"""WITH {_EVENTS}, v AS (SELECT event_id, event_type, ms / 60000.0::DOUBLE AS x, value AS y FROM e),
    m AS (SELECT *, (count(*) OVER w > 500) OR max(x) OVER w - min(x) OVER w > 100 OR max(y) OVER w - min(y) OVER w > 100 AS mega FROM v WINDOW w AS (PARTITION BY event_type)),
    c AS (SELECT *, CASE WHEN mega THEN CAST(floor(x / 500) AS BIGINT) ELSE 0 END AS cell_x, CASE WHEN mega THEN CAST(floor(y / 500) AS BIGINT) ELSE 0 END AS cell_y FROM m)
    SELECT event_id, cell_x, cell_y, CASE WHEN mega THEN CAST(floor((row_number() OVER (PARTITION BY event_type, cell_x, cell_y ORDER BY y, x, event_id) - 1) / 40) AS BIGINT) ELSE 0 END AS part FROM c""",
    "zone_severity": f"WITH {CHANGES} SELECT * FROM s",
    "change_counts": f"WITH {CHANGES} SELECT entity_type, layer, change_type, count(*) AS n FROM c GROUP BY GROUPING SETS ((entity_type, layer, change_type), (entity_type, change_type), (layer, change_type), (change_type), ())",
    "layer_statistics": f"""WITH {CHANGES} SELECT layer, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'deleted') AS deleted, count(*) FILTER (change_type = 'modified') AS modified, count(*) AS total,
      first(entity_type ORDER BY zone_id, line, x0, y0, entity_type) AS first_entity FROM c GROUP BY layer""",
    "top_layers": f"WITH {CHANGES}, {_TOP_LAYERS} SELECT * FROM t",
    "text_evidence": f"""WITH {CHANGES}, f AS (SELECT pair_id, layer, min((zone_id, line)) AS at_ FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY at_, layer) AS r FROM f)
    SELECT pair_id, {_TOP} AS evidence FROM r WHERE r <= 3 GROUP BY pair_id""",
    "executive_summary": f"""WITH {CHANGES}, {_TOP_LAYERS} SELECT pair_id, count(*) AS zones, CAST(sum(n) AS BIGINT) AS changes, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
      count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, first(top_layers) AS top_layers FROM s JOIN t USING (pair_id) GROUP BY pair_id""",
    "repeated_layers": f"WITH {CHANGES} SELECT layer, count(DISTINCT zone_id) AS zones, count(*) AS changes, count(DISTINCT pair_id) AS drawings FROM c GROUP BY layer",
    "cloud_regions": f"""WITH {CHANGES} SELECT pair_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(n) AS BIGINT) AS n, arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity,
      CASE WHEN count(DISTINCT change_type) = 1 THEN min(change_type) ELSE 'mixed' END AS change_type, min(zone_id) AS first_zone, count(*) AS zones FROM s GROUP BY pair_id""",
    "relocation_pairs": f"""WITH {CHANGES}, w AS (SELECT *, x1 - x0 AS width, y1 - y0 AS height FROM z)
    SELECT g.zone_id AS a_id, h.zone_id AS b_id, g.n_deleted AS n, CAST(round_even((abs(g.width - h.width) + abs(g.height - h.height)) * 1000, 0) AS BIGINT) AS size_diff_milli, CAST(round_even((h.x0 - g.x0) * 1000, 0) AS BIGINT) AS dx_milli
    FROM w g JOIN w h ON g.n_deleted = h.n_added AND g.n_deleted > 0 AND g.n_added = 0 AND h.n_deleted = 0 AND g.n_modified = 0 AND h.n_modified = 0
    WHERE abs(g.width - h.width) <= greatest(2, 0.01::DOUBLE * greatest(g.width, h.width)) AND abs(g.height - h.height) <= greatest(2, 0.01::DOUBLE * greatest(g.height, h.height))""",
    "folded_zones": f"""WITH {CHANGES}, f AS (SELECT zone_id, count(*) OVER w AS members, row_number() OVER (PARTITION BY change_type, severity, n_layers ORDER BY pair_id, zone_id) AS place FROM s WINDOW w AS (PARTITION BY change_type, severity, n_layers))
    SELECT *, members >= 3 AND place > 1 AS is_folded FROM f""",
    "capped_regions": f"""WITH {CHANGES}, r AS (SELECT pair_id, zone_id AS id, n, severity <> 'low' AS sel, row_number() OVER (PARTITION BY pair_id, severity <> 'low' ORDER BY n DESC, zone_id) AS r FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY sel AND r <= 5 ORDER BY n DESC, id, pair_id) AS t FROM r)
    SELECT pair_id, id, CASE WHEN NOT sel THEN 'not_selected' WHEN r > 5 THEN 'max_region_cap' WHEN t > 300 THEN 'max_total_region_cap' END AS reason FROM k""",
    "noise_scores": f"""WITH {CHANGES}, q AS (SELECT zone_id, count(*) AS n, bool_and(entity_type = 'TEXT') AS c, bool_and(y0 < 10) AS m, bool_or(layer LIKE 'S-BEAM%') AS s FROM c GROUP BY zone_id)
    SELECT zone_id, CAST(CASE WHEN n = 1 THEN 3 ELSE 0 END + CASE WHEN c THEN 3 ELSE 0 END + CASE WHEN m THEN 2 ELSE 0 END + CASE WHEN s THEN 0 ELSE 2 END AS BIGINT) AS noise_tenths FROM q""",
}
