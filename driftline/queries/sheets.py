"""Regions, pages, review and summaries over parts, customers, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import geometry as g
from driftline.functions import review
from driftline.operators import dashboard, sheets
from driftline.queries.common import table

LAYERS = ["S_BEAM", "A_TEXT_1", "X", "GRID_1", "PDF_PAGE_2", "DETAIL"]
TEXTS = ["H400", "NOTE 3", "plain", "X12", "5500 mm", "PIPE"]
ENTITIES = ["LINE", "DIMENSION", "HATCH", "LEADER", "zzz"]


def _pick(values: list, index) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def keyword_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    c = review.keyword_category(_pick(LAYERS, k % 6), _pick(ENTITIES, s % 5), _pick(TEXTS, s % 6))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.category", "c.severity", F.rint(F.col("c.confidence") * 100).cast("long").alias("confidence_cent"), "c.action")


def anchor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    score = review.anchor_score(F.concat(_pick(["widget", "beam B12 bolt", "plain", "see S-201"], k % 4), F.lit(" "), F.col("p_name")), _pick(["text", "dimension", "block_reference"], s % 3), _pick(["S-WALL", "X"], s % 2), ["bolt", "Red", "widget"])
    rows = table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), (k % 5 > 0).alias("parsed"))
    return rows.select("p_partkey", F.rint(F.col("score") * 100).cast("long").alias("score_cent"), review.anchor_confidence(F.col("score"), F.col("parsed")).alias("confidence"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = _pick(["added", "unchanged", "modified"], c("p_partkey") % 3)
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), kind.alias("change_type"), F.lit("text").alias("entity_type"), F.lit("X").alias("layer"), F.concat(F.lit("beam B"), c("p_size").cast("string")).alias("text"), c("p_retailprice").alias("x0"), F.lit(0.0).alias("y0"), (c("p_retailprice") + 2).alias("x1"), F.lit(4.0).alias("y1"))
    return review.change_evidence(rows)


def change_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("id", "evidence_id", "change_type", "anchor_text", F.array_join("domain_tags", ",").alias("tags"), F.rint(F.col("cx") * 1000).cast("long").alias("cx_milli"), F.rint("cy").cast("long").alias("cy"))


def review_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumn("run", F.col("id") % 20)
    return review.drafts(rows, "run", "rfi_reply", 5)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of sheets by brand: groups along a line, far from each other, and strays."""
    c, k, s = F.col, F.col("p_partkey"), F.col("p_size")
    x = (s % 6) * 900.0 + k % 7 * 8
    y = (s % 3) * 700.0 + k % 5 * 8
    return table(spark, sf_dir, "part").select(
        k.alias("id"), c("p_brand").alias("sheet"), _pick(["LINE", "TEXT", "CIRCLE", "LINE"], k % 4).alias("kind"), _pick(["S-BEAM", "X", "0"], k % 3).alias("layer"), F.when(k % 4 == 1, F.when((s % 6 == 2) & (k % 3 == 1), "PARTS TABLE").otherwise(c("p_name"))).alias("text"), F.lit("").alias("block"),
        g.box(x, y, x + 5, y + 4).alias("box"),
    )


def cluster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheets.cluster_regions(_entities(spark, sf_dir), "sheet")
    return rows.select("sheet", "region", "n", *[F.rint(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def viewport_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("s_suppkey")
    brands = table(spark, sf_dir, "part").select(c("p_brand").alias("sheet")).distinct()
    views = table(spark, sf_dir, "supplier").filter("s_suppkey < 30").select(k.alias("id"), g.box(k % 5 * 900.0, F.lit(0.0), k % 5 * 900.0 + 500 + k % 7 * 10, F.lit(1000.0)).alias("box"))
    return sheets.viewport_regions(_entities(spark, sf_dir), brands.crossJoin(F.broadcast(views)), "sheet", 2000.0)  # thirty views, on every sheet


def region_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as texts of regions by brand and size; some at the foot of their region, some with numbers."""
    c, k, s = F.col, F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 7 == 0, F.concat(F.lit("s20-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 7 == 1, F.concat(F.lit("see A"), s.cast("string"))).when(k % 7 == 2, " ").otherwise(c("p_name"))
    y = F.when(k % 5 == 0, 10.0).otherwise(60.0)
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", (s % 4).cast("string")).alias("region"), k.alias("ordinal"), _pick(["TEXT", "LINE", "MTEXT"], k % 3).alias("kind"), text.alias("text"), g.box(F.lit(10.0), y, F.lit(12.0), y + 2).alias("box"), g.box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0)).alias("frame"))
    return sheets.region_identity(rows, "region")


def region_override_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as decisions about the regions of their nation; the first of those that share a region holds."""
    c, k = F.col, F.col("s_suppkey")
    over = table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("pair"), k.alias("ordinal"), _pick(["manual_match", "unmatched_before", "manual_match", "maybe"], k % 4).alias("status"), F.concat(F.lit("b"), (k % 3).cast("string")).alias("before_id"), F.concat(F.lit("a"), k.cast("string")).alias("after_id"))
    after = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 > 0").select(c("s_nationkey").alias("pair"), F.concat(F.lit("a"), k.cast("string")).alias("id"))
    before = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("pair"), F.explode(F.array(F.lit("b0"), F.lit("b1"))).alias("id"))
    return sheets.region_overrides(over, before, after, "pair").select("pair", "ordinal", "error")


def compatible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = _pick(["cad", "PDF", "table"], k % 3), _pick(["CAD", "pdf", "table", "cad"], k % 4)
    return table(spark, sf_dir, "part").select("p_partkey", sheets.compatible(a, F.when(k % 11 != 0, b)).alias("compatible"))


def matched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as drawings and as pages: each like its own page, a little less like the next, some like none."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k)
    own = rows.select(k.alias("a_id"), k.alias("b_id"), F.when(k % 10 == 0, 0.4).when(k % 10 == 1, 0.7).otherwise(0.95).alias("score"))
    near = rows.filter("c_custkey % 10 > 2").select(k.alias("a_id"), (k - 1).alias("b_id"), F.lit(0.6).alias("score"))
    return sheets.matched_pages(own.unionByName(near), rows.select(k.alias("id")), rows.filter("c_custkey % 25 <> 24 OR c_custkey % 10 > 1").select(k.alias("id"))).select("a_id", "b_id", F.rint(F.col("score") * 100).cast("long").alias("score_cent"), "status")


def region_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in regions that moved, some records with an edit or a small shift."""
    c, k = F.col, F.col("p_partkey")
    old = table(spark, sf_dir, "part").select(k.alias("id"), c("p_brand").alias("sheet"), c("p_type").alias("kind"), (k % 50 * 2.0).alias("x"), (c("p_size") * 2.0).alias("y"))
    new = old.filter("id % 13 <> 0").select((F.col("id") + 1_000_000).alias("id"), "sheet", F.when(F.col("id") % 17 == 0, "OTHER").otherwise(F.col("kind")).alias("kind"), (F.col("x") + 500 + F.when(F.col("id") % 19 == 0, 1.0).when(F.col("id") % 7 == 0, 0.001).otherwise(0.0)).alias("x"), (F.col("y") - 40).alias("y"))
    brands = old.select("sheet").distinct()
    one = brands.select("sheet", F.lit("r").alias("region"), F.col("sheet").alias("match"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(80.0).alias("x1"), F.lit(200.0).alias("y1"))
    two = brands.select("sheet", F.lit("s").alias("region"), F.col("sheet").alias("match"), F.lit(500.0).alias("x0"), F.lit(-40.0).alias("y0"), F.lit(580.5).alias("x1"), F.lit(160.0).alias("y1"))
    out = sheets.region_diff(old, new, one, two, ["sheet"], ["kind"], 0.01)
    return out.groupBy("match", "change_type").agg(F.count("*").alias("n"), F.sum(F.rint("x")).cast("long").alias("x_sum"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col, F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (c("o_custkey") % 100).alias("pair_id"), k.alias("zone_id"), (F.floor(c("o_totalprice")) % 1000).cast("double").alias("priority_score"), (k % 40).alias("raw_change_count"), _pick(["High", "medium", "low"], k % 3).alias("severity"),
        _pick(["rebar", "other", "grid", "other", "mixed"], k % 5).alias("category"), (k % 6 == 0).alias("folded"), F.when(k % 6 == 0, _pick(["*AXIS*", "*DIM*"], k % 4 / 2)).otherwise("").alias("pattern"), F.concat(F.lit("D"), (c("o_custkey") % 100).cast("string")).alias("drawing"), k.alias("place"),
        F.concat(F.lit("L"), (c("o_custkey") % 7).cast("string")).alias("layer"),
    )


def dashboard_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _issues(spark, sf_dir)
    out = dashboard.drawing_summary(rows, rows.select("pair_id", "layer"))
    return out.select("pair_id", "zone_count", "raw_change_count", "structural_count", "folded_count", "high_count", F.rint(F.col("priority_score") * 100).cast("long").alias("priority_cent"), "major_layers")


def dashboard_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _issues(spark, sf_dir)
    return dashboard.pattern_summary(rows, rows.select("pattern", "layer"))


def artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 20).alias("pair_id"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("marked"))
    zones = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("zone_id"), F.col("c_nationkey").alias("pair_id"))
    return dashboard.with_artifacts(zones, s, ["marked"])


def viewer_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("elapsed_ms"), (F.col("user_id") % 3 == 0).alias("cache_hit"))
    out = dashboard.viewer_summary(rows, ["click", "view", "purchase", "render"])
    return out.select("stage", "n", "hits", *[F.rint(F.col(c) * 1000).cast("long").alias(f"{c}_milli") for c in ("p50", "p95", "worst")], F.rint(F.col("hit_rate") * 1e6).cast("long").alias("hit_micro"))


def first_record_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started"), F.col("ts").cast("timestamp").alias("written"))
    return dashboard.first_latency(rows).select("run_id", F.rint(F.col("first_record_us") / 1000).cast("long").alias("first_ms"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        keyword_categories, anchor_scores, change_evidence, review_drafts, cluster_regions, viewport_regions, region_identity, region_override_errors, compatible_files, matched_pages, region_diff, dashboard_drawings, dashboard_patterns, artifact_lookup,
        viewer_stages, first_record_latency,
    )
}

_EVIDENCE = "e AS (SELECT p_partkey AS id, 'chg-' || p_partkey AS evidence_id, ['added', 'unchanged', 'modified'][p_partkey % 3 + 1] AS change_type, 'beam B' || p_size AS anchor_text, p_retailprice + 1 AS cx FROM part WHERE p_partkey % 3 <> 1)"
_ISSUES = """i AS (SELECT o_custkey % 100 AS pair_id, o_orderkey AS zone_id, floor(o_totalprice) % 1000 AS priority_score, o_orderkey % 40 AS raw, o_orderkey % 3 = 0 AS high, o_orderkey % 5 IN (0, 2, 4) AS core, o_orderkey % 6 = 0 AS folded,
  CASE WHEN o_orderkey % 6 = 0 THEN ['*AXIS*', '*DIM*'][CAST(floor(o_orderkey % 4 / 2) AS INT) + 1] ELSE '' END AS pattern, 'D' || o_custkey % 100 AS drawing, 'L' || o_custkey % 7 AS layer FROM orders)"""

ORACLE_SQL = {
    "keyword_categories": f"""WITH v AS (SELECT p_partkey, {LAYERS!r}[p_partkey % 6 + 1] AS l, {ENTITIES!r}[p_size % 5 + 1] AS e, {TEXTS!r}[p_size % 6 + 1] AS t FROM part),
    c AS (SELECT *, CASE WHEN regexp_matches(l, '(?:^|_)(?:TEXT|NOTE)(?:$|_)') THEN 'text_label' WHEN regexp_matches(l, '(?:^|_)GRID(?:$|_)') THEN 'grid' WHEN regexp_matches(l, '(?:^|_)DETAIL(?:$|_)') THEN 'detail_drawing' WHEN regexp_matches(l, '(?:^|_)BEAM(?:$|_)') THEN 'structural_member' END AS cl,
      CASE t WHEN 'H400' THEN 'structural_member' WHEN 'PIPE' THEN 'structural_member' WHEN 'X12' THEN 'grid' WHEN 'NOTE 3' THEN 'note' END AS ct, CASE e WHEN 'LINE' THEN 'structural_member' WHEN 'DIMENSION' THEN 'dimension' WHEN 'HATCH' THEN 'detail_drawing' WHEN 'LEADER' THEN 'note' END AS ce FROM v),
    k AS (SELECT *, coalesce(cl, ct, ce, 'unknown') AS category FROM c), s AS (SELECT *, CASE WHEN starts_with(l, 'PDF_PAGE_') OR category IN ('text_label', 'note') THEN 'minor' WHEN category IN ('structural_member', 'grid') THEN 'critical' ELSE 'normal' END AS severity FROM k)
    SELECT p_partkey, category, severity, CAST(CASE WHEN cl = ct THEN 95 WHEN cl IS NOT NULL THEN 85 WHEN ct IS NOT NULL THEN 75 WHEN ce IS NOT NULL THEN 55 ELSE 30 END AS BIGINT) AS confidence_cent, CASE WHEN severity = 'minor' THEN 'confirm' ELSE 'review' END AS action FROM s""",
    "anchor_scores": """WITH v AS (SELECT p_partkey, p_partkey % 4 AS t, p_size % 3 AS e, p_size % 2 = 0 AS w, ['widget', 'beam B12 bolt', 'plain', 'see S-201'][p_partkey % 4 + 1] || ' ' || p_name AS x FROM part),
    h AS (SELECT *, (x LIKE '%bolt%')::INT + (x LIKE '%red%')::INT + (x LIKE '%widget%')::INT AS hits, CASE WHEN t = 1 OR e = 1 THEN true ELSE false END AS hi FROM v),
    s AS (SELECT *, 100 + least(800, hits * 300) + CASE WHEN e IN (1, 2) THEN 125 ELSE 0 END + CASE WHEN w THEN 75 ELSE 0 END + CASE WHEN t IN (1, 3) OR e = 1 OR w THEN 100 ELSE 0 END + CASE WHEN t IN (1, 3) OR e = 1 THEN 75 ELSE 0 END + CASE WHEN t IN (1, 3) THEN 75 ELSE 0 END AS score FROM h)
    SELECT p_partkey, CAST(score AS BIGINT) AS score_cent, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN score < 500 THEN 'low' ELSE 'medium' END WHEN score >= 500 THEN 'high' WHEN score >= 200 THEN 'medium' ELSE 'low' END AS confidence FROM s""",
    "change_evidence": f"WITH {_EVIDENCE} SELECT id, evidence_id, change_type, anchor_text, 'member_tag' AS tags, CAST(round_even(cx * 1000, 0) AS BIGINT) AS cx_milli, 2::BIGINT AS cy FROM e",
    "review_drafts": f"""WITH {_EVIDENCE}, r AS (SELECT *, id % 20 AS run, row_number() OVER (PARTITION BY id % 20 ORDER BY id) AS r FROM e)
    SELECT run, 'Structural Drawing RFI Reply Draft' AS subject, count(*) AS n_evidence, string_agg('- [' || evidence_id || '] ' || anchor_text, chr(10) ORDER BY r) FILTER (r <= 5) AS body FROM r GROUP BY run""",
    "cluster_regions": """WITH RECURSIVE e AS (SELECT p_partkey AS id, p_brand AS sheet, p_partkey % 4 AS k, p_partkey % 3 AS l, (p_size % 6) * 900.0::DOUBLE + p_partkey % 7 * 8 AS x, (p_size % 3) * 700.0::DOUBLE + p_partkey % 5 * 8 AS y, p_size % 6 = 2 AND p_partkey % 3 = 1 AND p_partkey % 4 = 1 AS tab FROM part),
    w AS (SELECT sheet, count(*) AS total, (max(x) + 5 - min(x)) AS ww, (max(y) + 4 - min(y)) AS hh FROM e GROUP BY sheet), g AS (SELECT *, greatest(sqrt(ww * ww + hh * hh) * 0.035::DOUBLE, 100) AS gap FROM w),
    n AS (SELECT a.id AS u, b.id AS v FROM e a JOIN e b USING (sheet) JOIN g USING (sheet) WHERE sqrt(greatest(abs(a.x - b.x) - 5, 0) ** 2 + greatest(abs(a.y - b.y) - 4, 0) ** 2) <= gap),
    r AS (SELECT id AS node, id AS seen FROM e UNION SELECT r.node, n.v FROM r JOIN n ON r.seen = n.u), z AS (SELECT node AS id, min(seen) AS region FROM r GROUP BY node),
    c AS (SELECT sheet, region, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) + 5 AS x1, max(y) + 4 AS y1, count(*) FILTER (k = 1) AS t, count(*) FILTER (k IN (0, 3)) AS ln, count(*) FILTER (k <> 1) AS st, bool_or(tab) AS named FROM e JOIN z USING (id) GROUP BY sheet, region),
    f AS (SELECT c.*, (x1 - x0) * (y1 - y0) <= ww * hh * 0.08::DOUBLE AS small, t >= greatest(4, floor(n * 0.35::DOUBLE)) AS heavy, ln >= 6 AND st <= greatest(2, floor(n * 0.20::DOUBLE)) AS ruled, total FROM c JOIN g USING (sheet))
    SELECT sheet, region, n, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM f WHERE n >= greatest(3, least(12, floor(total / 60)))
      AND ((st >= greatest(10, floor(n * 0.35::DOUBLE)) AND NOT heavy AND NOT ruled) OR NOT ((named AND (small OR heavy OR ruled)) OR (small AND heavy AND ruled)))""",
    "region_identity": r"""WITH v AS (SELECT p_brand || '/' || p_size % 4 AS region, p_partkey AS o, p_partkey % 5 = 0 AS banded, CASE p_partkey % 7 WHEN 0 THEN 's20-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'see A' || p_size ELSE p_name END AS t,
      CASE p_partkey % 7 WHEN 0 THEN 'S20-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'A' || p_size END AS num FROM part WHERE p_partkey % 3 <> 1 AND p_partkey % 7 <> 2),
    a AS (SELECT *, bool_or(banded) OVER (PARTITION BY region) AS any_ FROM v), s AS (SELECT *, banded OR NOT any_ AS src, row_number() OVER (PARTITION BY region, banded OR NOT any_ ORDER BY o) AS r FROM a)
    SELECT region, substring(string_agg(t, ' | ' ORDER BY r) FILTER (src AND r <= 8), 1, 240) AS title, coalesce(first(num ORDER BY o) FILTER (src AND num IS NOT NULL), first(num ORDER BY o) FILTER (num IS NOT NULL), '') AS number, bool_or(any_) AS from_title FROM s GROUP BY region""",
    "region_override_errors": """WITH v AS (SELECT s_nationkey AS pair, s_suppkey AS ordinal, s_suppkey % 4 AS t, s_suppkey % 3 AS b, s_suppkey % 5 = 0 AS lost FROM supplier), e AS (SELECT *, CASE WHEN t = 3 THEN 'unsupported status' WHEN b = 2 OR (lost AND t <> 1) THEN 'unknown region' END AS base FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair, b, base IS NULL ORDER BY ordinal) AS r FROM e) SELECT pair, ordinal, coalesce(base, CASE WHEN r > 1 THEN 'conflicts with an earlier one' END) AS error FROM r""",
    "compatible_files": "SELECT p_partkey, p_partkey % 11 <> 0 AND ((p_partkey % 3 = 0 AND p_partkey % 4 IN (0, 3)) OR (p_partkey % 3 = 1 AND p_partkey % 4 = 1)) AS compatible FROM part",
    "matched_pages": """WITH c AS (SELECT c_custkey AS k, c_custkey % 10 AS t FROM customer), p AS (SELECT k FROM c WHERE t >= 1)
    SELECT k AS a_id, k AS b_id, CAST(CASE WHEN t = 1 THEN 70 ELSE 95 END AS BIGINT) AS score_cent, CASE WHEN t = 1 THEN 'REVIEW_REQUIRED' ELSE 'AUTO_CONFIRMED' END AS status FROM c WHERE t >= 1
    UNION ALL SELECT k, NULL, 0, 'UNMATCHED_A' FROM c WHERE t = 0 UNION ALL SELECT NULL, k, 0, 'UNMATCHED_B' FROM c WHERE t = 0 AND (k % 25 <> 24 OR t > 1)""",
    "region_diff": """WITH o AS (SELECT p_partkey AS id, p_brand AS sheet, p_type AS kind, p_partkey % 50 * 2.0::DOUBLE AS x, p_size * 2.0::DOUBLE AS y FROM part),
    n AS (SELECT sheet, CASE WHEN id % 17 = 0 THEN 'OTHER' ELSE kind END AS kind, x + CASE WHEN id % 19 = 0 THEN 1 WHEN id % 7 = 0 THEN 0.001::DOUBLE ELSE 0 END AS x, y FROM o WHERE id % 13 <> 0),
    a AS (SELECT sheet, kind, round_even(x * 100, 0) AS x, y, count(*) AS n FROM o WHERE x BETWEEN 0 AND 80 AND y BETWEEN 0 AND 200 GROUP BY ALL), b AS (SELECT sheet, kind, round_even(x * 100, 0) AS x, y, count(*) AS n FROM n WHERE x BETWEEN 0 AND 80.5 AND y BETWEEN 0 AND 200 GROUP BY ALL),
    j AS (SELECT sheet AS match, x, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b USING (sheet, kind, x, y))
    SELECT match, CASE WHEN d > 0 THEN 'deleted' ELSE 'added' END AS change_type, CAST(sum(abs(d)) AS BIGINT) AS n, CAST(sum(abs(d) * (round_even(x / 100, 0) + CASE WHEN d < 0 THEN 500 ELSE 0 END)) AS BIGINT) AS x_sum FROM j WHERE d <> 0 GROUP BY 1, 2""",
    "dashboard_drawings": f"""WITH {_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY priority_score DESC, zone_id) AS r, row_number() OVER (PARTITION BY pair_id, core ORDER BY priority_score DESC, zone_id) AS c FROM i),
    t AS (SELECT pair_id, string_agg(layer, ', ' ORDER BY r) AS major_layers FROM (SELECT pair_id, layer, row_number() OVER (PARTITION BY pair_id ORDER BY count(*) DESC, layer) AS r FROM i GROUP BY pair_id, layer) WHERE r <= 4 GROUP BY pair_id)
    SELECT pair_id, count(*) AS zone_count, CAST(sum(raw) AS BIGINT) AS raw_change_count, count(*) FILTER (core) AS structural_count, count(*) FILTER (folded) AS folded_count, count(*) FILTER (high) AS high_count,
      CAST(round_even((coalesce(sum(priority_score) FILTER (core AND c <= 5), sum(priority_score) FILTER (r <= 5)) + sum(raw) * 0.01::DOUBLE + count(*) * 0.05::DOUBLE) * 100, 0) AS BIGINT) AS priority_cent, first(major_layers) AS major_layers FROM r JOIN t USING (pair_id) GROUP BY pair_id""",
    "dashboard_patterns": f"""WITH {_ISSUES}, p AS (SELECT * FROM i WHERE pattern <> ''), d AS (SELECT pattern, drawing, row_number() OVER (PARTITION BY pattern ORDER BY drawing) AS r FROM (SELECT DISTINCT pattern, drawing FROM p)), z AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY zone_id) AS r FROM p),
    t AS (SELECT pattern, layer, row_number() OVER (PARTITION BY pattern ORDER BY count(*) DESC, layer) AS r FROM p GROUP BY pattern, layer), a AS (SELECT pattern, CAST(sum(raw) AS BIGINT) AS raw_change_count, count(*) AS zone_count, count(DISTINCT drawing) AS drawings FROM p GROUP BY pattern)
    SELECT *, (SELECT string_agg(drawing, ' | ' ORDER BY r) FROM d WHERE d.pattern = a.pattern AND r <= 8) AS top_drawings, (SELECT string_agg(drawing || ':' || zone_id, ' | ' ORDER BY r) FROM z WHERE z.pattern = a.pattern AND r <= 5) AS zones,
      (SELECT string_agg(layer, ', ' ORDER BY r) FROM t WHERE t.pattern = a.pattern AND r <= 5) AS top_layers FROM a""",
    "artifact_lookup": "WITH s AS (SELECT s_nationkey % 20 AS pair_id, arg_max(s_name, s_suppkey) AS marked FROM supplier GROUP BY 1) SELECT c_nationkey AS pair_id, c_custkey AS zone_id, marked FROM customer LEFT JOIN s ON s.pair_id = c_nationkey",
    "viewer_stages": """WITH e AS (SELECT event_type AS stage, count(*) AS n, count(*) FILTER (user_id % 3 = 0) AS hits, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.95) AS b, max(value) AS c FROM events GROUP BY 1)
    SELECT s.stage, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, CAST(round_even(coalesce(a, 0) * 1000, 0) AS BIGINT) AS p50_milli, CAST(round_even(coalesce(b, 0) * 1000, 0) AS BIGINT) AS p95_milli, CAST(round_even(coalesce(c, 0) * 1000, 0) AS BIGINT) AS worst_milli, CAST(round_even(coalesce(hits / n, 0) * 1e6, 0) AS BIGINT) AS hit_micro
    FROM (VALUES ('click'), ('view'), ('purchase'), ('render')) s(stage) LEFT JOIN e USING (stage)""",
    "first_record_latency": "SELECT user_id AS run_id, CAST(round_even((epoch_us(min(ts)) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000.0::DOUBLE, 0) AS BIGINT) AS first_ms, count(*) AS n FROM events GROUP BY user_id",
}
