"""Spatial joins, assignment and alignment over parts as points (price, size) and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import geometry as g
from driftline.operators import alignment, assign, spatial
from driftline.queries.common import table

RADIUS = 1.0


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as points, and a revision of them with some moved and some gone."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    moved = rows.filter("id % 97 <> 0").select("id", "kind", F.when(F.col("id") % 3 == 0, F.col("x") + 0.25).otherwise(F.col("x")).alias("x"), F.when(F.col("id") % 5 == 0, F.col("y") + 0.5).otherwise(F.col("y")).alias("y"))
    return rows.filter("id % 89 <> 0"), moved


POINTS = """p AS (SELECT p_partkey AS id, p_type AS kind, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part),
a AS (SELECT * FROM p WHERE id % 89 <> 0),
b AS (SELECT id, kind, CASE WHEN id % 3 = 0 THEN x + 0.25 ELSE x END AS x, CASE WHEN id % 5 = 0 THEN y + 0.5 ELSE y END AS y FROM p WHERE id % 97 <> 0),
near AS (SELECT kind, a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM a JOIN b USING (kind)
  WHERE abs(a.x - b.x) <= 1.0 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.0)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _points(spark, sf_dir)
    return spatial.near_points(a, b, RADIUS, RADIUS, ["kind"])


def _micro(c: str):
    return F.floor(F.col(c) * 1e6).cast("long").alias(f"{c}_micro")


def grid_near_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("kind", "a_id", "b_id", _micro("distance"))


def near_match_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _points(spark, sf_dir)
    return spatial.near_points_plain(a, b, RADIUS, ["kind"]).select("kind", "a_id", "b_id", _micro("distance"))


def square_tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _points(spark, sf_dir)
    return spatial.in_square(a, b, 0.75, ["kind"])


def knn_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _points(spark, sf_dir)
    return spatial.nearest(a, b, 3, 0.5, ["kind"]).select("kind", "a_id", "b_id", F.col("rank").cast("long").alias("rank"), _micro("distance"))


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    wide = F.when(F.col("id") % 50 == 0, 40.0).otherwise(0.5)
    return rows.filter("id % 2 = 0").select("id", "kind", g.box(F.col("x"), F.col("y"), F.col("x") + wide, F.col("y") + 1).alias("box")), rows.filter("id % 2 = 1").select("id", "kind", g.box(F.col("x"), F.col("y"), F.col("x") + 0.5, F.col("y") + 2).alias("box"))


_BOXES = """p AS (SELECT p_partkey AS id, p_type AS kind, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part),
a AS (SELECT id, kind, x AS ax0, y AS ay0, x + CASE WHEN id % 50 = 0 THEN 40.0::DOUBLE ELSE 0.5::DOUBLE END AS ax1, y + 1 AS ay1 FROM p WHERE id % 2 = 0),
b AS (SELECT id, kind, x AS bx0, y AS by0, x + 0.5::DOUBLE AS bx1, y + 2 AS by1 FROM p WHERE id % 2 = 1),
j AS (SELECT kind, a.id AS a_id, b.id AS b_id, greatest(ax0 - bx1, bx0 - ax1, 0.0) AS dx, greatest(ay0 - by1, by0 - ay1, 0.0) AS dy,
  greatest(least(ax1, bx1) - greatest(ax0, bx0), 0.0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0.0) AS inter, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) AS total FROM a JOIN b USING (kind)),
pairs AS (SELECT kind, a_id, b_id, sqrt(dx * dx + dy * dy) AS gap, inter / (total - inter) AS iou FROM j WHERE sqrt(dx * dx + dy * dy) <= 0.5)"""


def bbox_overlap_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _boxes(spark, sf_dir)
    return spatial.near_boxes(a, b, 0.5, 2.0, ["kind"]).select("kind", "a_id", "b_id", _micro("gap"), F.rint(F.col("iou") * 1e6).cast("long").alias("iou_micro"))


def viewport_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_window(_points(spark, sf_dir)[0], 910.0, 10.0, 960.0, 30.0).select("id", "kind")


def mutual_best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.mutual_best(_near(spark, sf_dir), [F.col("distance"), F.col("a_id"), F.col("b_id")]).select("kind", "a_id", "b_id", _micro("distance"))


def competing_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rivals of a point go into the join that makes its edges, so that edges, many more than points, don't move."""
    sides = _points(spark, sf_dir)
    edges = _near(spark, sf_dir).select("a_id", "b_id", (1 - F.col("distance")).alias("score"))
    a, b = (p.join(assign.rivals(edges, end).withColumnRenamed(end, "id").hint("merge"), "id") for p, end in zip(sides, ("a_id", "b_id"), strict=True))
    edges = spatial.near_points(a, b, RADIUS, RADIUS, ["kind"]).withColumn("score", 1 - F.col("distance"))
    return assign.margins(edges).select("a_id", "b_id", *[F.rint(F.col(c) * 1e6).cast("long").alias(f"{c}_micro") for c in ("score", "competing", "margin")])


def pair_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _near(spark, sf_dir).select("a_id", "b_id", (1 - F.col("distance")).alias("score"))
    chosen = assign.mutual_best(edges, [-F.col("score"), F.col("a_id"), F.col("b_id")])
    return assign.alternates(edges, chosen).select("a_id", F.array_join(F.transform("alternates", lambda x: x.cast("string")), ",").alias("alternates"))


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in one place have the same distances, so places are joined, not parts."""
    edges, a, b = spatial.near_places(*_points(spark, sf_dir), RADIUS, RADIUS, ["kind"])
    return assign.greedy_classes(edges, a, b, ["distance", "a_id", "b_id"]).select("kind", "a_id", "b_id", _micro("distance"))


def hungarian_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in one place are one node of a flow, so components of copies are solved whole."""
    edges, a, b = spatial.near_places(*_points(spark, sf_dir), RADIUS, RADIUS, ["kind"])
    return assign.optimal_classes(edges, a, b, "distance", ["kind"]).select("a_id", "b_id", _micro("distance"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their moved selves, matched by key."""
    a, b = _points(spark, sf_dir)
    return a.select("id", "kind", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select("id", F.col("x").alias("bx"), F.col("y").alias("by")), "id")


_PAIRS = f"{POINTS}, m AS (SELECT a.id, a.kind, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM a JOIN b USING (id))"


def median_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.median_shift(_pairs(spark, sf_dir), ["kind"]).select("kind", "n_pairs", *[F.rint(F.col(c) * 1e4).cast("long").alias(c) for c in ("dx", "dy")])


def upper_median_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.upper_median_shift(_pairs(spark, sf_dir), ["kind"]).select("kind", *[F.rint(F.col(c) * 1e4).cast("long").alias(c) for c in ("dx", "dy")])


def dominant_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.dominant_shift(_pairs(spark, sf_dir), ["kind"])


def robust_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.robust_extents(_points(spark, sf_dir)[0], ["kind"])


def alignment_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return pairs.groupBy("kind").agg(alignment.inlier_share(pairs, F.lit(0.0), F.lit(0.0), 0.3).alias("share")).select("kind", F.rint(F.col("share") * 1e6).cast("long").alias("share_micro"))


def rigid_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovers a known shift and rotation of all parts."""
    t = F.struct(F.lit(12.5).alias("dx"), F.lit(-3.0).alias("dy"), F.lit(7.0).alias("angle"))
    rows = _points(spark, sf_dir)[0].select(F.col("x").alias("ax"), F.col("y").alias("ay"), g.rotated(F.col("x"), F.col("y"), t).alias("b"))
    found = alignment.rigid_transform(rows.select("ax", "ay", F.col("b.x").alias("bx"), F.col("b.y").alias("by")))
    return spark.createDataFrame([tuple(round(v * 1000) for v in found)], "dx_milli long, dy_milli long, angle_milli long, inliers_milli long")


def geometry_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_retailprice"), F.col("p_size").cast("double")
    a, b = g.box(x, y, x + 2, y + 1), g.box(x + 1, y, x + 4, y + 3)
    return p.select(
        "p_partkey", g.steps(x, 0.25).alias("quarters"), F.rint(g.angle_delta(x, y * 37) * 1000).cast("long").alias("angle_milli"), F.rint(g.box_similarity(a, b) * 1e6).cast("long").alias("box_similarity_micro"),
        F.rint(g.size_similarity(x, y, x + 1, y) * 1e6).cast("long").alias("size_similarity_micro"), F.rint(g.distance_score(y, 30.0) * 1e6).cast("long").alias("distance_score_micro"),
        F.rint(g.iou(a, b) * 1e6).cast("long").alias("iou_micro"), g.boxes_meet(a, b).alias("meet"), g.contains(a, b).alias("holds"), g.cloud_chords(b, 2.0).cast("long").alias("chords"),
    )


def transform_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rigid transform, its inverse and their composition: how far a point comes back from where it was."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    t = F.struct(F.lit(3.0).alias("dx"), F.lit(-4.0).alias("dy"), F.lit(30.0).alias("angle"))
    there = p.withColumn("t", t).withColumn("q", g.rotated(F.col("x"), F.col("y"), F.col("t")))
    back = there.withColumn("r", g.rotated(F.col("q.x"), F.col("q.y"), g.inverse(F.col("t")))).withColumn("u", g.composed(F.col("t"), g.inverse(F.col("t"))))
    off = F.abs(F.col("r.x") - F.col("x")) + F.abs(F.col("r.y") - F.col("y")) + F.abs(F.col("u.dx")) + F.abs(F.col("u.dy")) + F.abs(F.col("u.angle"))
    return back.select("p_partkey", F.floor(F.col("q.x") * 1000 + 0.0005).cast("long").alias("qx_milli"), (off < 1e-6).alias("returns"))


def polyline_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed outlines from the lines of an order: the least rotation of their vertices, either way round."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("v"))
    points = F.transform("v", lambda p: p["q"])
    return lines.select("l_orderkey", F.array_join(F.transform(g.least_rotation(points), lambda q: q.cast("string")), ",").alias("outline"))


QUERIES = {
    f.__name__: f
    for f in (
        grid_near_match, near_match_plain, square_tolerance_match, knn_part, bbox_overlap_iou, viewport_window, mutual_best_pairs, competing_margins, pair_alternates, greedy_pairs, hungarian_pairs,
        median_shift, upper_median_shift, dominant_shift, robust_extents, alignment_inliers, rigid_transform, geometry_scalars, transform_round_trip, polyline_canonical,
    )
}

_MICRO = "CAST(floor(distance * 1e6) AS BIGINT) AS distance_micro"
_BEST = "row_number() OVER (PARTITION BY a_id ORDER BY distance, a_id, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY distance, a_id, b_id) AS rb"

ORACLE_SQL = {
    "grid_near_match": f"WITH {POINTS} SELECT kind, a_id, b_id, {_MICRO} FROM near",
    "near_match_plain": f"WITH {POINTS} SELECT kind, a_id, b_id, {_MICRO} FROM near",
    "square_tolerance_match": f"WITH {POINTS} SELECT kind, a.id AS a_id, b.id AS b_id FROM a JOIN b USING (kind) WHERE abs(a.x - b.x) <= 0.75 AND abs(a.y - b.y) <= 0.75",
    "knn_part": f"""WITH {POINTS}, d AS (SELECT kind, a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM a JOIN b USING (kind))
    SELECT kind, a_id, b_id, rank, {_MICRO} FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS rank FROM d) WHERE rank <= 3""",
    "bbox_overlap_iou": f"WITH {_BOXES} SELECT kind, a_id, b_id, CAST(floor(gap * 1e6) AS BIGINT) AS gap_micro, CAST(round_even(iou * 1e6, 0) AS BIGINT) AS iou_micro FROM pairs",
    "viewport_window": f"WITH {POINTS} SELECT id, kind FROM a WHERE x BETWEEN 910 AND 960 AND y BETWEEN 10 AND 30",
    "mutual_best_pairs": f"WITH {POINTS} SELECT kind, a_id, b_id, {_MICRO} FROM (SELECT *, {_BEST} FROM near) WHERE ra = 1 AND rb = 1",
    "competing_margins": f"""WITH {POINTS}, e AS (SELECT a_id, b_id, 1 - distance AS score FROM near),
    o AS (SELECT x.a_id, x.b_id, x.score, coalesce(max(y.score), 0) AS competing FROM e x LEFT JOIN e y ON (x.a_id = y.a_id AND x.b_id <> y.b_id) OR (x.b_id = y.b_id AND x.a_id <> y.a_id) GROUP BY ALL)
    SELECT a_id, b_id, CAST(round_even(score * 1e6, 0) AS BIGINT) AS score_micro, CAST(round_even(greatest(competing, 0) * 1e6, 0) AS BIGINT) AS competing_micro, CAST(round_even((score - greatest(competing, 0)) * 1e6, 0) AS BIGINT) AS margin_micro FROM o""",
    "pair_alternates": f"""WITH {POINTS}, c AS (SELECT a_id, b_id FROM (SELECT *, {_BEST} FROM near) WHERE ra = 1 AND rb = 1),
    r AS (SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY 1 - distance DESC, b_id) AS r FROM near ANTI JOIN c USING (a_id, b_id))
    SELECT a_id, string_agg(CAST(b_id AS VARCHAR), ',' ORDER BY r) AS alternates FROM r WHERE r <= 3 GROUP BY a_id""",
    "median_shift": f"WITH {_PAIRS} SELECT kind, count(*) AS n_pairs, CAST(round_even(median(bx - ax) * 1e4, 0) AS BIGINT) AS dx, CAST(round_even(median(by_ - ay) * 1e4, 0) AS BIGINT) AS dy FROM m GROUP BY kind",
    "upper_median_shift": f"""WITH {_PAIRS}, r AS (SELECT kind, bx - ax AS dx, by_ - ay AS dy, row_number() OVER (PARTITION BY kind ORDER BY bx - ax) - 1 AS rx, row_number() OVER (PARTITION BY kind ORDER BY by_ - ay) - 1 AS ry, count(*) OVER (PARTITION BY kind) AS n FROM m)
    SELECT kind, CAST(round_even(max(dx) FILTER (rx = n // 2) * 1e4, 0) AS BIGINT) AS dx, CAST(round_even(max(dy) FILTER (ry = n // 2) * 1e4, 0) AS BIGINT) AS dy FROM r GROUP BY kind""",
    "dominant_shift": f"""WITH {_PAIRS}, c AS (SELECT kind, CAST(round_even((bx - ax) * 1000, 0) AS BIGINT) AS dx_milli, CAST(round_even((by_ - ay) * 1000, 0) AS BIGINT) AS dy_milli, count(*) AS n FROM m GROUP BY ALL),
    r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY kind) AS BIGINT) AS total, row_number() OVER (PARTITION BY kind ORDER BY n DESC, dx_milli, dy_milli) AS r FROM c)
    SELECT kind, dx_milli, dy_milli, n, total FROM r WHERE r = 1 AND n >= 3 AND n >= 0.5 * total""",
    "robust_extents": f"""WITH {POINTS}, r AS (SELECT kind, x, y, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY x) - 1 AS rx, row_number() OVER (PARTITION BY kind ORDER BY y) - 1 AS ry FROM a),
    i AS (SELECT *, CASE WHEN n >= 8 THEN floor(n * 0.01::DOUBLE) ELSE 0 END AS f, CASE WHEN n >= 8 THEN least(floor(n * (1 - 0.01::DOUBLE)), n - 1) ELSE n - 1 END AS l FROM r),
    e AS (SELECT kind, first(n) AS n, max(x) FILTER (rx = f) AS x0, max(x) FILTER (rx = l) AS x1, max(y) FILTER (ry = f) AS y0, max(y) FILTER (ry = l) AS y1 FROM i GROUP BY kind)
    SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM e""",
    "alignment_inliers": f"WITH {_PAIRS} SELECT kind, CAST(round_even(avg(CASE WHEN sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) <= 0.3 THEN 1.0 ELSE 0.0 END) * 1e6, 0) AS BIGINT) AS share_micro FROM m GROUP BY kind",
    "geometry_scalars": """WITH v AS (SELECT p_partkey, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part),
    d AS (SELECT *, abs(fmod(x - y * 37, 360.0) + CASE WHEN fmod(x - y * 37, 360.0) < 0 THEN 360 ELSE 0 END) AS d FROM v)
    SELECT p_partkey, CAST(round_even(x / 0.25, 0) AS BIGINT) AS quarters, CAST(round_even(least(d, 360 - d) * 1000, 0) AS BIGINT) AS angle_milli,
      CAST(round_even(((x + 2 - x) / (x + 4 - (x + 1)) + (y + 1 - y) / (y + 3 - y)) / 2 * 1e6, 0) AS BIGINT) AS box_similarity_micro, CAST(round_even((x * y) / ((x + 1) * y) * 1e6, 0) AS BIGINT) AS size_similarity_micro,
      CAST(round_even(greatest(1 - y / 30, 0) * 1e6, 0) AS BIGINT) AS distance_score_micro, 100000 + 0 * p_partkey AS iou_micro, true AS meet, false AS holds, CAST(greatest(8, ceil(2 * ((x + 4 - (x + 1)) + 3) / 2)) AS BIGINT) AS chords FROM d""",
    "transform_round_trip": """SELECT p_partkey, CAST(floor((p_retailprice * cos(radians(30.0)) - p_size * sin(radians(30.0)) + 3) * 1000 + 0.0005) AS BIGINT) AS qx_milli, true AS returns FROM part""",
    "polyline_canonical": """WITH v AS (SELECT l_orderkey, list(q ORDER BY l_linenumber, q) AS q FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey),
    t AS (SELECT l_orderkey, list_concat(q[i + 1:], q[:i]) AS r FROM (SELECT l_orderkey, q, unnest(range(len(q))) AS i FROM v) UNION ALL SELECT l_orderkey, list_concat(q[i + 1:], q[:i]) FROM (SELECT l_orderkey, list_reverse(q) AS q, unnest(range(len(q))) AS i FROM v))
    SELECT l_orderkey, array_to_string(min(r), ',') AS outline FROM t GROUP BY l_orderkey""",
}
