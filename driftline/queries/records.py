"""Expansion, styles, descriptors, pairing, overrides and whole comparisons over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import classify
from driftline.functions import text as t
from driftline.operators import assign, expand, pairing
from driftline.plans import compare
from driftline.queries.common import table


def _micro(**values) -> list:
    return [F.rint(v * 1e6).cast("long").alias(f"{k}_micro") for k, v in values.items()]


def block_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as blocks in nations, customers as inserts of their nation."""
    c = F.col
    children = table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("block"), c("s_suppkey").alias("child_id"), (c("s_suppkey") % 50).cast("double").alias("cx"), (c("s_suppkey") % 7).cast("double").alias("cy"), F.lit(2.0).alias("radius"), F.when(c("s_suppkey") % 2 == 0, "0").otherwise("S").alias("layer"))
    inserts = table(spark, sf_dir, "customer").select(c("c_custkey").alias("insert_id"), c("c_nationkey").alias("block"), c("c_acctbal").alias("x"), (c("c_custkey") * 1.0).alias("y"), F.lit(2.0).alias("sx"), F.lit(-1.0).alias("sy"), ((c("c_custkey") % 4) * 90.0).alias("angle"), c("c_mktsegment").alias("layer"))
    return expand.expand_once(inserts, children).select("insert_id", "child_id", "layer", "radius", F.rint(c("x") * 1000).cast("long").alias("x_milli"), F.rint(c("y") * 1000).cast("long").alias("y_milli"))


def nested_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations over suppliers, with offsets along the way."""
    c = F.col
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), c("n_regionkey")).alias("parent"), F.concat(F.lit("n"), c("n_nationkey")).alias("child"), (c("n_nationkey") * 10.0).alias("dx"), F.lit(1.0).alias("dy"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), c("s_nationkey")).alias("parent"), F.concat(F.lit("s"), c("s_suppkey")).alias("child"), F.lit(0.5).alias("dx"), c("s_suppkey").cast("double").alias("dy"))
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), c("r_regionkey")).alias("root"))
    return expand.expand_nested(nation.unionByName(supplier), roots, 5).withColumn("level", c("level").cast("long"))


def style_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("layer"), F.when(c("c_custkey") % 3 == 0, (c("c_custkey") - c("c_custkey") % 100).cast("long")).alias("parent"), F.when(c("c_custkey") % 3 == 0, "BYBLOCK").when(c("c_custkey") % 3 == 1, "BYLAYER").otherwise(F.concat(F.lit("c"), c("c_nationkey"))).alias("color"))
    layers = spark.createDataFrame([("HOUSEHOLD", "red"), ("MACHINERY", "blue"), ("BUILDING", "green")], "layer string, color string")
    return expand.resolved_style(rows, layers, "color")


def normalisation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.when(F.col("l_linenumber") == 1, "LINE").otherwise("TEXT").alias("kind"), (F.col("l_discount") * 1.0).alias("size"))
    return expand.normalisation_report(rows, "x", "y", 0.25, expand.near_zero(F.col("kind"), F.col("size")))


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_retailprice"), F.col("p_size").cast("double")
    one, two = expand.line_key(x, y, y, x, 0.5), expand.line_key(y, x, x, y, 0.5)
    return p.select("p_partkey", one.alias("key"), (one == two).alias("either_way"))


def block_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.block_fingerprint(table(spark, sf_dir, "part"), "p_brand", "p_name")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("drawing"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("L"), F.col("l_suppkey") % 5).alias("layer"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return expand.descriptors(rows, "drawing").select("drawing", "n_entities", "x0", "y0", "x1", "y1", F.array_join("layers", ",").alias("layers"), *[F.coalesce(F.try_element_at("kinds", F.lit(k)), F.lit(0)).alias(f"n_{k.lower()}") for k in "ANR"])


def histogram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of neighbouring drawings by their counts of kinds."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("d"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("k")).agg(F.count("*").alias("n"))
    maps = rows.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    pairs = maps.join(maps.select((F.col("d") - 1).alias("d"), F.col("m").alias("m2")), "d")
    return pairs.select("d", *_micro(cosine=classify.map_cosine(F.col("m"), F.col("m2"))))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("DWG-"), (c("doc_id") % 60).cast("string")).alias("number"), t.tokens(c("text")).alias("title"), F.when(c("doc_id") % 9 != 0, F.substring(F.md5("text"), 1, 16)).alias("visual"),
        F.substring(F.md5(t.lowered(c("text"))), 1, 16).alias("hash"), (c("n_chars") % 7 + 1).cast("double").alias("w"), (c("n_chars") % 5 + 1).cast("double").alias("h"), "lang",
    )


def _scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of even against odd ids that share a drawing number, with their scores."""
    rows = _pages(spark, sf_dir)
    a, b = rows.filter("doc_id % 4 < 2"), rows.filter("doc_id % 4 >= 2")
    pairs = pairing.blocked_pairs(a, b, [F.concat(F.lit("n"), F.expr("cast(regexp_extract(number, '[0-9]+', 0) as int) div 2")), F.concat(F.lit("h"), F.col("hash"))], "doc_id", "doc_id")
    side = lambda df, s: df.select(F.col("doc_id").alias(f"{s}_id"), F.struct(*[c for c in df.columns if c != "doc_id"]).alias(s))
    both = pairs.join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")
    from driftline.functions.geometry import size_similarity

    number = pairing.number_score(F.col("a.number"), F.col("b.number"))
    title = t.token_similarity(F.col("a.title"), F.col("b.title"))
    score = pairing.page_score(number, title, t.hash_similarity(F.col("a.visual"), F.col("b.visual")), t.hash_similarity(F.col("a.hash"), F.col("b.hash")), size_similarity(F.col("a.w"), F.col("a.h"), F.col("b.w"), F.col("b.h")))
    return both.select("a_id", "b_id", score.alias("score"))


def page_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_pages(spark, sf_dir).select("a_id", "b_id", *_micro(score=F.col("score")))


def page_pair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each candidate by score and margin to the next."""
    rows = assign.competing(_scored_pages(spark, sf_dir))
    return rows.select("a_id", "b_id", pairing.status(F.col("score"), F.col("margin")).alias("status"))


def file_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    o = table(spark, sf_dir, "orders")
    pairs = o.select(c("o_orderkey").alias("a_id"), c("o_custkey").alias("k"), c("o_totalprice").alias("p"), c("o_orderstatus").alias("s")).join(o.select(c("o_orderkey").alias("b_id"), c("o_custkey").alias("k"), c("o_totalprice").alias("q"), c("o_orderstatus").alias("u")), "k").filter("a_id < b_id")
    close = F.least(c("p"), c("q")) / F.greatest(c("p"), c("q"))
    score = pairing.file_score(close, F.when(c("s") == c("u"), 1.0).otherwise(0.0), F.lit(0.5), close * close, F.lit(1.0), c("a_id") % 10 == c("b_id") % 10, c("s") == c("u"), (c("a_id") + c("b_id")) % 7 == 0)
    region = pairing.region_score(F.when(c("s") == c("u"), 1.0).otherwise(0.0), close, close, F.lit(0.9), F.lit(1.0), c("s") != c("u"), (c("a_id") + c("b_id")) % 3 == 0)
    return pairs.select("a_id", "b_id", *_micro(score=score, region=region), pairing.status(score).alias("status"))


def _overrides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    candidates = e.select((F.col("event_id") % 200).alias("a_id"), (F.col("event_id") * 7 % 200).alias("b_id"), F.col("value").alias("score")).groupBy("a_id", "b_id").agg(F.max("score").alias("score"))
    status = F.when(F.col("event_type") == "click", "confirmed").when(F.col("event_type") == "view", "rejected").otherwise("unmatched")
    over = e.filter("event_id % 11 = 0").select((F.col("user_id") % 200).alias("a_id"), (F.col("user_id") * 3 % 200).alias("b_id"), status.alias("status"), "event_id")
    return candidates, over


def override_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.last_wins(_overrides(spark, sf_dir)[1], ["a_id"], ["event_id"])


def override_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, over = _overrides(spark, sf_dir)
    return pairing.apply_overrides(candidates, over, ["event_id"]).select("a_id", "b_id", *_micro(score=F.col("score")), "source")


def pair_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as pages that several kinds of events were confirmed for."""
    return pairing.duplicates(table(spark, sf_dir, "events").select(F.col("user_id").alias("a_id"), F.col("event_id").alias("b_id")).unionByName(table(spark, sf_dir, "events").filter("event_id % 9 = 0").select((F.col("user_id") + 1).alias("a_id"), F.col("event_id").alias("b_id"))))


def unmatched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("a_id"))
    return pairing.unmatched(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", chosen, "a_id")


def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    states = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("confirmed").alias("status"))
    return pairing.with_state(zones, states, ["c_nationkey"])


def region_of_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    boxes = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("sheet"), (c("p_retailprice") - 900).alias("x0"), c("p_size").cast("double").alias("y0"), (c("p_retailprice") - 895).alias("x1"), (c("p_size") + 5.0).alias("y1"))
    regions = spark.range(12).select((c("id")).alias("region_id"), (c("id") * 16.0).alias("rx0"), (c("id") % 4 * 9.0).alias("ry0"), (c("id") * 16.0 + 20 + c("id") % 3 * 9).alias("rx1"), (c("id") % 4 * 9.0 + 18).alias("ry1"))
    sheets = boxes.select("sheet").distinct()
    return pairing.region_of(boxes, sheets.crossJoin(F.broadcast(regions)), ["sheet"], near=2.0).withColumn("tier", c("tier").cast("long"))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as records, spread out so that only their own revisions are near, and a revision of them."""
    c = F.col
    old = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("id"), F.when(c("p_partkey") % 4 == 0, "TEXT").otherwise("LINE").alias("kind"), F.when(c("p_partkey") % 6 == 0, "S-BEAM").otherwise(c("p_brand")).alias("layer"), (c("p_partkey") * 200.0).alias("x"), c("p_size").cast("double").alias("y"),
        F.md5("p_type").alias("shape"), F.lit("solid").alias("style"), c("p_name").alias("text"),
    )
    k = c("id")
    new = old.filter("id % 31 <> 0").select(
        (k + 1_000_000).alias("id"), "kind", F.when(k % 29 == 0, "MOVED").otherwise(c("layer")).alias("layer"), F.when(k % 7 == 0, c("x") + 0.5).when(k % 11 == 0, c("x") + 2).when(k % 13 == 0, c("x") + 90).otherwise(c("x")).alias("x"), "y", "shape",
        F.when(k % 5 == 0, "dashed").otherwise("solid").alias("style"), F.when(k % 17 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")).alias("text"),
    )
    return old, new


def canonical_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.Canonical().compare(*_records(spark, sf_dir))


def legacy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.Legacy().compare(*_records(spark, sf_dir))


def rule_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.get(F.array(*map(F.lit, ["A-BEAM", "XGRID", "DIMS", "DETL", "HATCH", "zzz"])), (F.col("p_partkey") % 6).cast("int"))
    entity = F.get(F.array(*map(F.lit, ["LINE", "TEXT", "INSERT"])), (F.col("p_partkey") % 18 / 6).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", classify.zone_category(layer, entity).alias("c"))
    k = F.col("p_partkey")
    boost = classify.zone_boost(F.col("c.category"), F.get(F.array(*map(F.lit, ["Added", "modified"])), (k % 2).cast("int")), k % 700)
    return rows.select("p_partkey", "c.category", F.rint(F.col("c.confidence") * 100).cast("long").alias("confidence_cent"), boost.alias("boost"), classify.zone_label(F.col("c.category")).alias("label"))


def structural_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, ["SHD13@200 top", "beam B1", "GRID X3", "wall on AXIS 2", "plain 450 mm", "HD10 @ 150 wall", "beams, H-400 x 200"])), (F.col("p_partkey") % 7).cast("int"))
    like = classify.dimension_like(text, F.when(F.col("p_size") > 40, "A-DIMS").otherwise("X"), F.lit("TEXT"), F.when(F.col("p_size") < 4, "Dimension").otherwise("modified"), F.col("p_size") > 20)
    return table(spark, sf_dir, "part").select("p_partkey", classify.structural_category(text, like).alias("category"))


def embedding_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three prototypes a label (its smallest ids) against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    prototypes = rows.filter("vec_id < 60").select(F.col("label").alias("category"), "embedding")
    found = classify.by_prototypes(rows.filter("vec_id >= 60"), F.broadcast(prototypes), "vec_id", "embedding", "category", 0.2, 0.02)
    return found.select("vec_id", "category", F.rint(F.col("similarity") * 1e5).cast("long").alias("similarity_e5"))


QUERIES = {
    f.__name__: f
    for f in (
        block_expansion, nested_expansion, style_resolution, normalisation_report, line_keys, block_fingerprints, descriptors, histogram_cosine, page_pair_scores, page_pair_status, file_pair_scores, override_last_wins,
        override_applied, pair_uniqueness, unmatched_nodes, review_state, region_of_box, canonical_diff, legacy_diff, rule_category, structural_category, embedding_classify,
    )
}


def _m(**values: str) -> str:
    return ", ".join(f"CAST(round_even(({v}) * 1e6, 0) AS BIGINT) AS {k}_micro" for k, v in values.items())


_PAGES = r"""w AS (SELECT doc_id, 'DWG-' || (doc_id % 60) AS number, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS title, CASE WHEN doc_id % 9 <> 0 THEN substring(md5(text), 1, 16) END AS visual,
  substring(md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 1, 16) AS hash, CAST(n_chars % 7 + 1 AS DOUBLE) AS w, CAST(n_chars % 5 + 1 AS DOUBLE) AS h FROM documents),
j AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, CASE WHEN a.number = b.number THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS num, CASE WHEN len(a.title) = 0 OR len(b.title) = 0 THEN 0 ELSE len(list_intersect(a.title, b.title)) / len(list_distinct(list_concat(a.title, b.title))) END AS tit,
  CASE WHEN a.visual IS NULL OR b.visual IS NULL THEN 0.5::DOUBLE ELSE 1 - bit_count(xor(('0x' || a.visual)::UBIGINT, ('0x' || b.visual)::UBIGINT)) / 64 END AS vis, 1 - bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT)) / 64 AS txt,
  CASE WHEN a.w = b.w AND a.h = b.h THEN 1 ELSE least((a.w * a.h) / (b.w * b.h), (b.w * b.h) / (a.w * a.h)) END AS siz
  FROM w a JOIN w b ON a.doc_id % 4 < 2 AND b.doc_id % 4 >= 2 AND ((a.doc_id % 60) // 2 = (b.doc_id % 60) // 2 OR a.hash = b.hash)),
g AS (SELECT *, 0.35::DOUBLE * num + 0.25::DOUBLE * tit + 0.20::DOUBLE * vis + 0.15::DOUBLE * txt + 0.05::DOUBLE * siz AS s FROM j),
e AS (SELECT a_id, b_id, greatest(0, least(1, CASE WHEN num = 0 THEN least(s, 0.59::DOUBLE) WHEN tit >= 0.7::DOUBLE THEN greatest(s, 0.92::DOUBLE) ELSE s END)) AS score FROM g)"""

_OVER = """c AS (SELECT event_id % 200 AS a_id, event_id * 7 % 200 AS b_id, max(value) AS score FROM events GROUP BY 1, 2),
v AS (SELECT user_id % 200 AS a_id, user_id * 3 % 200 AS b_id, CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'rejected' ELSE 'unmatched' END AS status, event_id FROM events WHERE event_id % 11 = 0),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY event_id DESC) = 1),
f AS (SELECT * FROM l WHERE status = 'confirmed' QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY event_id DESC) = 1)"""

_RECORDS = """o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'TEXT' ELSE 'LINE' END AS kind, CASE WHEN p_partkey % 6 = 0 THEN 'S-BEAM' ELSE p_brand END AS layer, p_name FROM part),
m AS (SELECT *, id % 31 <> 0 AS stays, id % 29 = 0 AS relayered, CASE WHEN id % 7 = 0 THEN 0.5::DOUBLE WHEN id % 11 = 0 THEN 2 WHEN id % 13 = 0 THEN 90 ELSE 0 END AS shift, id % 5 = 0 AS restyled, id % 17 = 0 AS reworded, CASE WHEN layer = 'S-BEAM' THEN 0.1::DOUBLE ELSE 1 END AS tol FROM o)"""


def _diff_sql(matched: str, removed: str, names: list[str], checks: list[str], new_layer: str) -> str:
    path = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in zip(names, checks, strict=True)) + "], lambda x: x IS NOT NULL), ',')"
    return f"""WITH {_RECORDS}, k AS (SELECT *, stays AND ({matched}) AS paired FROM m)
    SELECT id AS a_id, id + 1000000 AS b_id, kind, layer, CASE WHEN {path} = '' THEN 'unchanged' ELSE 'modified' END AS change_type, {path} AS paths FROM k WHERE paired
    UNION ALL SELECT id, NULL, kind, layer, '{removed}', '' FROM k WHERE NOT paired
    UNION ALL SELECT NULL, id + 1000000, kind, {new_layer}, 'added', '' FROM k WHERE stays AND NOT paired"""


ORACLE_SQL = {
    "block_expansion": """WITH k AS (SELECT s_nationkey AS block, s_suppkey AS child_id, CAST(s_suppkey % 50 AS DOUBLE) AS cx, CAST(s_suppkey % 7 AS DOUBLE) AS cy, CASE WHEN s_suppkey % 2 = 0 THEN '0' ELSE 'S' END AS cl FROM supplier),
    i AS (SELECT c_custkey AS insert_id, c_nationkey AS block, c_acctbal AS x, c_custkey AS y, (c_custkey % 4) * 90 AS angle, c_mktsegment AS layer FROM customer)
    SELECT insert_id, child_id, CASE WHEN cl = '0' THEN layer ELSE cl END AS layer, 3.0::DOUBLE AS radius, CAST(round_even((2 * cx * cos(radians(angle)) + cy * sin(radians(angle)) + x) * 1000, 0) AS BIGINT) AS x_milli,
      CAST(round_even((2 * cx * sin(radians(angle)) - cy * cos(radians(angle)) + y) * 1000, 0) AS BIGINT) AS y_milli FROM i JOIN k USING (block)""",
    "nested_expansion": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_nationkey * 10.0::DOUBLE AS dx, 1.0::DOUBLE AS dy FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.5, s_suppkey FROM supplier),
    t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0::BIGINT AS level FROM region UNION ALL SELECT root, child, x + dx, y + dy, level + 1 FROM t JOIN e ON t.node = e.parent) SELECT * FROM t""",
    "style_resolution": """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS layer, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - c_custkey % 100 END AS parent, CASE c_custkey % 3 WHEN 0 THEN 'BYBLOCK' WHEN 1 THEN 'BYLAYER' ELSE 'c' || c_nationkey END AS color FROM customer),
    l AS (SELECT * FROM (VALUES ('HOUSEHOLD', 'red'), ('MACHINERY', 'blue'), ('BUILDING', 'green')) t(layer, col))
    SELECT c.id, CASE c.color WHEN 'BYLAYER' THEN l.col WHEN 'BYBLOCK' THEN CASE WHEN p.color = 'BYLAYER' THEN q.col ELSE p.color END ELSE c.color END AS color,
      CASE WHEN c.color = 'BYLAYER' THEN 'layer' WHEN c.color = 'BYBLOCK' AND p.color IS NOT NULL THEN 'block' WHEN c.color = 'BYBLOCK' THEN 'none' ELSE 'entity' END AS source
    FROM c LEFT JOIN c p ON c.parent = p.id LEFT JOIN l ON l.layer = c.layer LEFT JOIN l q ON q.layer = p.layer""",
    "normalisation_report": """WITH v AS (SELECT l_extendedprice AS x, l_quantity AS y, l_linenumber = 1 AND l_discount <= 1e-6 AS dropped FROM lineitem)
    SELECT count(*) AS n_in, count(*) FILTER (NOT dropped) AS n_out, count(*) FILTER (dropped) AS n_removed, count(*) FILTER (NOT dropped AND (abs(x - round_even(x / 0.25, 0) * 0.25) > 1e-9 OR abs(y - round_even(y / 0.25, 0) * 0.25) > 1e-9)) AS n_rounded FROM v""",
    "line_keys": """WITH v AS (SELECT p_partkey, CAST(round_even(p_retailprice / 0.5, 0) AS BIGINT) AS a, CAST(round_even(p_size / 0.5::DOUBLE, 0) AS BIGINT) AS b FROM part)
    SELECT p_partkey, concat_ws(',', least(a, b), greatest(a, b), greatest(a, b), least(a, b)) AS key, true AS either_way FROM v""",
    "block_fingerprints": "SELECT p_brand, sha256(string_agg(p_name, chr(31) ORDER BY p_name)) AS fingerprint, count(*) AS n_texts FROM part GROUP BY p_brand",
    "descriptors": """SELECT l_orderkey % 300 AS drawing, count(*) AS n_entities, min(l_extendedprice) AS x0, min(l_quantity) AS y0, max(l_extendedprice) AS x1, max(l_quantity) AS y1, string_agg(DISTINCT 'L' || (l_suppkey % 5), ',' ORDER BY 'L' || (l_suppkey % 5)) AS layers,
      count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_returnflag = 'R') AS n_r FROM lineitem GROUP BY 1""",
    "histogram_cosine": f"""WITH h AS (SELECT l_orderkey % 300 AS d, l_returnflag || l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY ALL), q AS (SELECT d, sqrt(sum(n * n)) AS q FROM h GROUP BY d),
    p AS (SELECT a.d, sum(a.n * b.n) AS dot FROM h a JOIN h b ON b.d = a.d + 1 AND a.k = b.k GROUP BY a.d)
    SELECT x.d, {_m(cosine="coalesce(dot, 0) / (x.q * y.q)")} FROM q x JOIN q y ON y.d = x.d + 1 LEFT JOIN p ON p.d = x.d""",
    "page_pair_scores": f"WITH {_PAGES} SELECT a_id, b_id, {_m(score='score')} FROM e",
    "page_pair_status": f"""WITH {_PAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, a_id, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_id, b_id) AS rb FROM e),
    c AS (SELECT *, coalesce(CASE WHEN ra = 1 THEN nth_value(score, 2) OVER wa ELSE first_value(score) OVER wa END, 0) AS ca, coalesce(CASE WHEN rb = 1 THEN nth_value(score, 2) OVER wb ELSE first_value(score) OVER wb END, 0) AS cb FROM r
      WINDOW wa AS (PARTITION BY a_id ORDER BY ra ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), wb AS (PARTITION BY b_id ORDER BY rb ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT a_id, b_id, CASE WHEN score >= 0.85::DOUBLE AND score - greatest(ca, cb) >= 0.1::DOUBLE THEN 'AUTO_CONFIRMED' WHEN score >= 0.6::DOUBLE THEN 'REVIEW_REQUIRED' ELSE 'UNMATCHED' END AS status FROM c""",
    "file_pair_scores": f"""WITH p AS (SELECT a.o_orderkey AS a_id, b.o_orderkey AS b_id, least(a.o_totalprice, b.o_totalprice) / greatest(a.o_totalprice, b.o_totalprice) AS c, a.o_orderstatus = b.o_orderstatus AS same FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey),
    w AS (SELECT *, 0.35::DOUBLE * c + 0.20::DOUBLE * same::INT + 0.20::DOUBLE * 0.5 + 0.20::DOUBLE * c * c + 0.05::DOUBLE AS s0, same::INT * 0.30::DOUBLE + c * 0.20::DOUBLE + c * 0.20::DOUBLE + 0.9::DOUBLE * 0.25 + 0.05::DOUBLE AS r0 FROM p),
    x AS (SELECT *, CASE WHEN a_id % 10 = b_id % 10 THEN greatest(s0, 0.88::DOUBLE) ELSE s0 END AS s1, CASE WHEN NOT same THEN least(r0, 0.49::DOUBLE) ELSE r0 END AS r1 FROM w),
    y AS (SELECT *, CASE WHEN same THEN greatest(s1, 0.86::DOUBLE) ELSE s1 END AS s2, CASE WHEN (a_id + b_id) % 3 = 0 AND c < 0.2::DOUBLE THEN greatest(r1, least(0.82::DOUBLE, c * 0.35::DOUBLE + 0.9::DOUBLE * 0.45 + 0.10::DOUBLE)) ELSE r1 END AS r2 FROM x),
    z AS (SELECT *, greatest(0, least(1, CASE WHEN (a_id + b_id) % 7 = 0 THEN least(s2, 0.59::DOUBLE) ELSE s2 END)) AS s, greatest(0, least(1, r2)) AS r FROM y)
    SELECT a_id, b_id, {_m(score="s", region="r")}, CASE WHEN s >= 0.85::DOUBLE THEN 'AUTO_CONFIRMED' WHEN s >= 0.6::DOUBLE THEN 'REVIEW_REQUIRED' ELSE 'UNMATCHED' END AS status FROM z""",
    "override_last_wins": f"WITH {_OVER} SELECT * FROM l",
    "override_applied": f"""WITH {_OVER} SELECT a_id, b_id, {_m(score="score")}, 'AUTO' AS source FROM c WHERE a_id NOT IN (SELECT a_id FROM f) AND b_id NOT IN (SELECT b_id FROM f) AND (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM l WHERE status = 'rejected') AND a_id NOT IN (SELECT a_id FROM l WHERE status = 'unmatched')
    UNION ALL SELECT a_id, b_id, 1000000, 'MANUAL' FROM f""",
    "pair_uniqueness": """WITH p AS (SELECT user_id AS a_id, event_id AS b_id FROM events UNION ALL SELECT user_id + 1, event_id FROM events WHERE event_id % 9 = 0) SELECT a_id AS node, count(DISTINCT b_id) AS n, 'a' AS side FROM p GROUP BY a_id HAVING count(DISTINCT b_id) > 1
    UNION ALL SELECT b_id, count(DISTINCT a_id), 'b' FROM p GROUP BY b_id HAVING count(DISTINCT a_id) > 1""",
    "unmatched_nodes": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)",
    "review_state": "SELECT c_custkey, c_nationkey, CASE WHEN n_nationkey IS NOT NULL THEN 'confirmed' ELSE 'needs_review' END AS status FROM customer LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) ON c_nationkey = n_nationkey",
    "region_of_box": """WITH b AS (SELECT p_partkey AS id, p_retailprice - 900 AS x0, CAST(p_size AS DOUBLE) AS y0, p_retailprice - 895 AS x1, p_size + 5.0::DOUBLE AS y1 FROM part),
    r AS (SELECT i AS region_id, i * 16.0::DOUBLE AS rx0, i % 4 * 9.0::DOUBLE AS ry0, i * 16.0::DOUBLE + 20 + i % 3 * 9 AS rx1, i % 4 * 9.0::DOUBLE + 18 AS ry1 FROM range(12) t(i)),
    p AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(least(x1, rx1) - greatest(x0, rx0), 0) * greatest(least(y1, ry1) - greatest(y0, ry0), 0) / ((x1 - x0) * (y1 - y0)) AS part FROM b, r),
    q AS (SELECT *, cx BETWEEN rx0 AND rx1 AND cy BETWEEN ry0 AND ry1 AS inside, sqrt(greatest(rx0 - cx, cx - rx1, 0) ** 2 + greatest(ry0 - cy, cy - ry1, 0) ** 2) AS gap, greatest(2.0::DOUBLE, 0.02::DOUBLE * sqrt((rx1 - rx0) ** 2 + (ry1 - ry0) ** 2)) AS reach FROM p),
    t AS (SELECT id, region_id, CASE WHEN inside THEN 1 WHEN part >= 0.2::DOUBLE THEN 2 WHEN gap <= reach THEN 3 END AS tier, CASE WHEN inside THEN (rx1 - rx0) * (ry1 - ry0) WHEN part >= 0.2::DOUBLE THEN -part ELSE gap END AS k FROM q)
    SELECT id, region_id, CAST(tier AS BIGINT) AS tier FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, k, region_id) = 1""",
    # The canonical score of a moved pair: .25 + .15 layer + .40 (1 - d / 5) + .20 shape, from .62 on.
    "canonical_diff": _diff_sql("shift < 5 AND 0.25 + 0.15 * CASE WHEN relayered THEN 0.35 ELSE 1 END + 0.40 * (1 - shift / 5) + 0.20 >= 0.62", "removed", ["position", "text", "layer"], ["shift > tol", "reworded", "relayered"], "CASE WHEN relayered THEN 'MOVED' ELSE layer END"),
    "legacy_diff": _diff_sql("NOT relayered AND shift <= CASE WHEN kind = 'TEXT' THEN 50 ELSE 5 END", "deleted", ["position", "text", "style"], ["shift > tol", "reworded", "restyled"], "CASE WHEN relayered THEN 'MOVED' ELSE layer END"),
    "rule_category": """WITH v AS (SELECT p_partkey, p_partkey % 6 AS l, p_partkey % 18 // 6 AS e FROM part), r AS (SELECT p_partkey, CASE l WHEN 0 THEN 'structural_member' WHEN 1 THEN 'grid' WHEN 2 THEN 'dimension' WHEN 3 THEN 'detail' WHEN 4 THEN 'layer' ELSE CASE e WHEN 1 THEN 'dimension' WHEN 2 THEN 'detail' ELSE 'other' END END AS category,
      CAST(CASE WHEN l IN (0, 1) THEN 85 WHEN l IN (2, 3, 4) THEN 70 WHEN e IN (1, 2) THEN 50 ELSE 20 END AS BIGINT) AS confidence_cent FROM v)
    SELECT *, CASE WHEN category = 'other' THEN p_partkey % 700 // 50 ELSE CASE category WHEN 'structural_member' THEN 10 WHEN 'grid' THEN 8 WHEN 'detail' THEN 4 WHEN 'dimension' THEN 2 ELSE 1 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 700 >= 500 THEN 3 WHEN p_partkey % 700 >= 100 THEN 1 ELSE 0 END END AS boost,
      CASE category WHEN 'structural_member' THEN '구조 부재 변경' WHEN 'grid' THEN '그리드 변경' WHEN 'dimension' THEN '치수/주석 변경' WHEN 'detail' THEN '상세/마킹 변경' WHEN 'layer' THEN '레이어/표기 변경' ELSE '기타 변경' END AS label FROM r""",
    "structural_category": """WITH v AS (SELECT p_partkey, p_partkey % 7 AS t, p_size > 40 OR p_size < 4 OR (p_partkey % 7 IN (0, 4, 5, 6) AND p_size > 20) AS d FROM part)
    SELECT p_partkey, CASE t WHEN 0 THEN 'rebar' WHEN 1 THEN CASE WHEN d THEN 'mixed' ELSE 'member' END WHEN 2 THEN CASE WHEN d THEN 'mixed' ELSE 'grid' END WHEN 3 THEN 'mixed' WHEN 4 THEN CASE WHEN d THEN 'dimension' ELSE 'other' END WHEN 5 THEN 'mixed' ELSE CASE WHEN d THEN 'mixed' ELSE 'member' END END AS category FROM v""",
    "embedding_classify": """WITH p AS (SELECT label AS category, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 60), s AS (SELECT vec_id, category, max(list_cosine_similarity(v.embedding::DOUBLE[], p.e)) AS s FROM embeddings v, p WHERE vec_id >= 60 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS n FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, category))
    SELECT vec_id, CASE WHEN s >= 0.2::DOUBLE AND s - coalesce(n, -1) >= 0.02::DOUBLE THEN category END AS category, CAST(round_even(s * 1e5, 0) AS BIGINT) AS similarity_e5 FROM r WHERE r = 1""",
}
