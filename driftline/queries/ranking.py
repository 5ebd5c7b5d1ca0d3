"""Scores, limits, ranks and counters over lineitem and events as change lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import classify
from driftline.operators import ranking
from driftline.queries.common import table
from driftline.queries.zones import CHANGES, _changes, _zones

LAYERS = ["S-BEAM", "A-TEXT", "DIMS", "GRID-1", "XREF", "TEMP", "OTHER"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a layer by supplier, a kind by flag and their priority."""
    c = F.col
    kind = F.when(c("l_returnflag") == "A", "ADDED").when(c("l_returnflag") == "R", "DELETED").otherwise("MODIFIED")
    layer = F.get(F.array(*map(F.lit, LAYERS)), (c("l_suppkey") % len(LAYERS)).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_orderkey", "l_partkey", kind.alias("change_type"), layer.alias("layer"), (c("l_discount") * 100).cast("int").alias("noise"), c("l_extendedprice").alias("price"), c("l_quantity").alias("qty"))
    found = classify.profile(c("layer"))
    rows = rows.withColumn("found", found)
    return rows.withColumns({"level": F.col("found.level"), "score": classify.priority_score(F.col("change_type"), F.col("found"))}).drop("found")


_SCORED = """l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'ADDED' WHEN 'R' THEN 'DELETED' ELSE 'MODIFIED' END AS change_type,
  ['S-BEAM', 'A-TEXT', 'DIMS', 'GRID-1', 'XREF', 'TEMP', 'OTHER'][l_suppkey % 7 + 1] AS layer, CAST(trunc(l_discount * 100) AS INTEGER) AS noise, l_extendedprice AS price, l_quantity AS qty FROM lineitem),
p AS (SELECT * FROM (VALUES ('S-BEAM', 5, 2.0::DOUBLE), ('A-TEXT', 3, 1.0::DOUBLE), ('DIMS', 4, 1.5::DOUBLE), ('GRID-1', 4, 1.5::DOUBLE), ('XREF', 2, 0.7::DOUBLE), ('TEMP', 1, 0.3::DOUBLE), ('OTHER', 3, 1.0::DOUBLE)) t(layer, level, weight)),
s AS (SELECT l.*, level, least(100, level * 20 * CASE change_type WHEN 'DELETED' THEN 1.2::DOUBLE WHEN 'MODIFIED' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * weight) AS score FROM l JOIN p USING (layer))"""


def _deci(c: str):
    return F.rint(F.col(c) * 100).cast("long").alias(f"{c}_cent")


def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("change_type", "layer", "level").agg(F.count("*").alias("n"), F.max("score").alias("score")).select("change_type", "layer", F.col("level").cast("long").alias("level"), "n", _deci("score"))


def priority_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of levels, review counts and mean score."""
    rows = _scored(spark, sf_dir)
    return rows.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("level") == 5).alias("review"), F.rint(F.avg("score") * 100).cast("long").alias("mean_cent"))


def priority_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("level"), F.desc("score"), F.col("price"), F.col("id"), F.col("l_partkey")]
    return ranking.top_n(_scored(spark, sf_dir), order, 100).select("id", "layer", "change_type", _deci("score"))


def rank_in_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.ranked(_zones(spark, sf_dir), ["pair_id"], [F.desc("n"), F.col("severity"), F.col("zone_id")])
    return rows.select("pair_id", "zone_id", F.col("rank").cast("long").alias("rank"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five structural zones of each drawing."""
    return ranking.first_per(_zones(spark, sf_dir).filter("structural"), ["pair_id"], [F.desc("n"), F.col("zone_id")], 5).select("pair_id", "zone_id", "n")


def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_share(_zones(spark, sf_dir), [F.desc("n"), F.col("zone_id")], 10.0, ["pair_id"]).select("pair_id", "zone_id", F.col("rank").cast("long").alias("rank"))


FILTERS = ("priority", "change_type", "layer", "confidence")


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = [F.col("level") >= 3, F.col("change_type") != "MODIFIED", ~F.col("layer").isin("XREF", "OTHER"), F.col("noise") < 5]
    return ranking.cascade(_scored(spark, sf_dir), list(zip(FILTERS, keep, strict=True)))


def exclusion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cascade_counts(_cascade(spark, sf_dir), FILTERS)


def filtered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).filter("excluded_by IS NULL").groupBy("layer", "change_type").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


def overflow_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.overflow(_changes(spark, sf_dir), "pair_id", [F.col("zone_id"), F.col("line"), F.col("x0"), F.col("layer"), F.col("change_type")], 60, "change_type")


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ranking.even_sample(rows, "event_type", ["event_id"], 150).select("event_id", "event_type")


def overlay_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.pages(_zones(spark, sf_dir), "pair_id", ["zone_id"], 10)
    return rows.groupBy("pair_id", F.col("page").cast("long").alias("page")).agg(F.min("zone_id").alias("first_zone"), F.max("zone_id").alias("last_zone"), F.count("*").alias("n"))


def viewport_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return ranking.viewport(rows, 900.0, 5.0, 1000.0, 45.0, 100, 10.0)


def visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x0"), (F.col("s_suppkey") * 10.0).alias("y0"), (F.col("s_acctbal") + 600).alias("x1"), (F.col("s_suppkey") * 10.0 + 300).alias("y1"))
    return ranking.visible_tiles(rows, 256, 1)


def first_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_per(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def dashboard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    area = (c("x1") - c("x0")) * (c("y1") - c("y0"))
    category = F.when(c("n_dimension") > 0, "dimension").when(c("structural"), "member").otherwise("other")
    score = classify.dashboard_score(c("severity"), c("n"), c("n_added"), c("n_deleted"), c("n_modified"), area, c("structural"), category, c("n_modified") > 1, c("n") > 2, c("n_layers") == 1)
    return _zones(spark, sf_dir).select("zone_id", F.rint(score * 100).cast("long").alias("score_cent"))


def confidence_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((1 - c("l_discount")).alias("ocr"), (c("l_quantity") / 2).alias("d"), (1 - c("l_tax") * 4).alias("ssim"), c("l_returnflag"), c("l_suppkey"))
    overall = classify.confidence(c("ocr"), c("d"), c("ssim"), F.lit(1.0))
    found = F.struct(F.when(c("l_suppkey") % 11 == 0, 5).otherwise(3).alias("level"))
    rows = rows.withColumn("overall", overall).withColumn("reasons", F.array_join(classify.review_reasons(found, c("ocr"), c("d"), c("ssim"), c("overall")), ","))
    return rows.groupBy("l_returnflag", "reasons").agg(F.count("*").alias("n"), F.rint(F.avg("overall") * 1000).cast("long").alias("overall_milli"))


QUERIES = {
    f.__name__: f
    for f in (
        priority_scores, priority_statistics, priority_topn, rank_in_drawing, review_queue, top_share, exclusion_counters, filtered_changes, overflow_truncation, even_sample, overlay_pages,
        viewport_overlays, visible_tiles, first_duplicate_wins, last_write_wins, dashboard_scores, confidence_blend,
    )
}

_CASCADE = """f AS (SELECT *, CASE WHEN NOT level >= 3 THEN 'priority' WHEN change_type = 'MODIFIED' THEN 'change_type' WHEN layer IN ('XREF', 'OTHER') THEN 'layer' WHEN NOT noise < 5 THEN 'confidence' END AS x FROM s)"""

ORACLE_SQL = {
    "priority_scores": f"WITH {_SCORED} SELECT change_type, layer, CAST(level AS BIGINT) AS level, count(*) AS n, CAST(round_even(max(score) * 100, 0) AS BIGINT) AS score_cent FROM s GROUP BY ALL",
    "priority_statistics": f"WITH {_SCORED} SELECT CAST(level AS BIGINT) AS level, count(*) AS n, count(*) FILTER (level = 5) AS review, CAST(round_even(avg(score) * 100, 0) AS BIGINT) AS mean_cent FROM s GROUP BY level",
    "priority_topn": f"WITH {_SCORED} SELECT id, layer, change_type, CAST(round_even(score * 100, 0) AS BIGINT) AS score_cent FROM s ORDER BY level DESC, score DESC, price, id, l_partkey LIMIT 100",
    "rank_in_drawing": f"WITH {CHANGES} SELECT pair_id, zone_id, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, severity, zone_id) AS rank FROM s",
    "review_queue": f"WITH {CHANGES} SELECT pair_id, zone_id, n FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, zone_id) AS r FROM s WHERE structural) WHERE r <= 5",
    "top_share": f"WITH {CHANGES} SELECT pair_id, zone_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, zone_id) AS r, count(*) OVER (PARTITION BY pair_id) AS k FROM s) WHERE r <= greatest(1, floor(k * 10.0::DOUBLE / 100))",
    "exclusion_counters": f"WITH {_SCORED}, {_CASCADE} SELECT count(*) AS total_count, count(*) FILTER (x IS NULL) AS filtered_count, " + ", ".join(f"count(*) FILTER (x = '{n}') AS excluded_by_{n}" for n in FILTERS) + " FROM f",
    "filtered_changes": f"WITH {_SCORED}, {_CASCADE} SELECT layer, change_type, count(*) AS n, sum(qty) AS qty FROM f WHERE x IS NULL GROUP BY ALL",
    "overflow_truncation": f"""WITH {CHANGES} SELECT pair_id, change_type, count(*) FILTER (r <= 60) AS kept, count(*) FILTER (r > 60) AS omitted
    FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY zone_id, line, x0, layer, change_type) AS r FROM c) GROUP BY ALL""",
    "even_sample": """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    k AS (SELECT event_type, n, least(n, 150) AS k, unnest(range(least(n, 150))) AS j FROM (SELECT DISTINCT event_type, n FROM r))
    SELECT event_id, event_type FROM r WHERE (event_type, i) IN (SELECT (event_type, CAST(round_even(j * n / k::DOUBLE, 0) AS BIGINT)) FROM k)""",
    "overlay_pages": f"""WITH {CHANGES} SELECT pair_id, page, min(zone_id) AS first_zone, max(zone_id) AS last_zone, count(*) AS n
    FROM (SELECT pair_id, zone_id, (row_number() OVER (PARTITION BY pair_id ORDER BY zone_id) - 1) // 10 AS page FROM s) GROUP BY ALL""",
    "viewport_overlays": """WITH v AS (SELECT p_partkey AS id, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part WHERE p_retailprice BETWEEN 900 AND 1000 AND p_size BETWEEN 5 AND 45), m AS (SELECT count(*) > 100 AS many FROM v)
    SELECT CASE WHEN many THEN NULL ELSE id END AS id, CASE WHEN many THEN floor(x / 10) * 10 ELSE x END AS x, CASE WHEN many THEN floor(y / 10) * 10 ELSE y END AS y, count(*) AS n FROM v, m GROUP BY 1, 2, 3""",
    "visible_tiles": """WITH v AS (SELECT s_suppkey AS id, CAST(floor(s_acctbal / 256) AS BIGINT) AS ax, CAST(floor((s_acctbal + 600) / 256) AS BIGINT) AS bx, CAST(floor(s_suppkey * 10.0::DOUBLE / 256) AS BIGINT) AS ay, CAST(floor((s_suppkey * 10.0::DOUBLE + 300) / 256) AS BIGINT) AS by_ FROM supplier),
    x AS (SELECT *, unnest(range(ax - 1, bx + 2)) AS tx FROM v), y AS (SELECT *, unnest(range(ay - 1, by_ + 2)) AS ty FROM x)
    SELECT id, tx, ty, NOT (tx BETWEEN ax AND bx AND ty BETWEEN ay AND by_) AS prefetch FROM y""",
    "first_duplicate_wins": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "last_write_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "dashboard_scores": f"""WITH {CHANGES}, q AS (SELECT *, CASE WHEN n_dimension > 0 THEN 'dimension' WHEN structural THEN 'member' ELSE 'other' END AS category FROM s)
    SELECT zone_id, CAST(round_even((CASE severity WHEN 'critical' THEN 420.0::DOUBLE WHEN 'high' THEN 320 WHEN 'medium' THEN 180 ELSE 80 END + least(n, 1000) * 0.22::DOUBLE + least(sqrt(greatest((x1 - x0) * (y1 - y0), 0)), 2500) * 0.04::DOUBLE
      + CASE WHEN (n_added > 0)::INT + (n_deleted > 0)::INT + (n_modified > 0)::INT >= 2 THEN 40 ELSE 0 END + least(n_modified, 100) * 0.6::DOUBLE + CASE WHEN structural THEN 70 ELSE 0 END
      + CASE category WHEN 'dimension' THEN 560 WHEN 'member' THEN 680 ELSE 0 END + CASE WHEN n_modified > 1 THEN 220 ELSE 0 END + CASE WHEN n > 2 THEN 35 ELSE 0 END)
      * CASE WHEN n_layers <> 1 THEN 1.0::DOUBLE WHEN category = 'other' THEN 0.45::DOUBLE ELSE 0.75::DOUBLE END * 100, 0) AS BIGINT) AS score_cent FROM q""",
    "confidence_blend": """WITH v AS (SELECT 1 - l_discount AS ocr, l_quantity / 2 AS d, 1 - l_tax * 4 AS ssim, l_returnflag, l_suppkey % 11 = 0 AS crit FROM lineitem),
    o AS (SELECT *, round_even(greatest(0, least(1, ocr)) * 0.30::DOUBLE + greatest(0, 1 - d / 20) * 0.25::DOUBLE + greatest(0, least(1, ssim)) * 0.25::DOUBLE + 0.20::DOUBLE, 4) AS overall FROM v),
    r AS (SELECT *, array_to_string(list_filter([CASE WHEN ocr < 0.7::DOUBLE OR overall < 0.7::DOUBLE THEN 'ocr_low_confidence' END, CASE WHEN d > 10 THEN 'near_match_ambiguous' END, CASE WHEN ssim < 0.7::DOUBLE THEN 'visual_difference' END, CASE WHEN crit THEN 'structural_change' END], lambda x: x IS NOT NULL), ',') AS reasons FROM o)
    SELECT l_returnflag, reasons, count(*) AS n, CAST(round_even(avg(overall) * 1000, 0) AS BIGINT) AS overall_milli FROM r GROUP BY ALL""",
}
