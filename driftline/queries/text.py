"""Text, token, hash and layer-name functions over documents, parts, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as t
from driftline.queries.common import table

LAYERS = ["S-BEAM-1", "A-COL", "TITLE_BLOCK", "REV", "SHEET-PILE", "SHEET-01", "PROBLEM", "BM_12", "GRID12", "기둥-2", "도면틀", "0", "A-WALL-TEMP", "BORDERLINE", "X_REVISION_2", ""]


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, LAYERS)), (F.col("p_partkey") % len(LAYERS)).cast("int")).alias("layer"))


_LAYERS = f"v AS (SELECT p_partkey, [{', '.join(repr(x) for x in LAYERS)}][p_partkey % {len(LAYERS)} + 1] AS layer FROM part)"


def layer_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.col("layer")
    return _layers(spark, sf_dir).select("p_partkey", t.is_structural(layer).alias("structural"), t.is_title_block(layer).alias("title_block"), t.matches_any(layer, ["*TEMP*", "0", "?-COL"]).alias("ignored"), t.layer_prefix(layer).alias("prefix"))


def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.text_hash(t.lowered(text)).alias("hash"), F.length(t.plain(text)).cast("long").alias("n_chars"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in engineering notation made from parts."""
    c, k, n = F.col, F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("col  H"), k, F.lit("x200 X 8x13 at grid b-"), n), F.concat(F.lit("HD13 pl"), n, F.lit("  "), k, F.lit(" mm")),
        F.concat(F.lit("el +"), k, F.lit(".5 dwg s20_"), F.lpad((c("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("a")), F.concat(F.lit("B2F det-"), k, F.lit(" box "), k, F.lit("X300 2,5m")),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*forms), (c("p_partkey") % 4).cast("int")).alias("note"))


def text_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("p_partkey", t.canonical(F.col("note")).alias("canonical"), F.sha2(t.canonical(F.col("note")), 256).alias("digest"))


def drawing_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("p_partkey", t.drawing_number(F.col("note")).alias("drawing_number"), t.sheet_token(F.col("note")).alias("sheet"), t.longest(F.regexp_extract_all(F.col("note"), F.lit("[a-z]+"), F.lit(0))).alias("longest"))


def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    begin = F.when(k % 3 == 0, F.concat(F.lit("s2"), (k % 10).cast("string"), F.lit(" "), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("_"))).when(k % 3 == 1, "").otherwise(F.concat(F.lit("AB"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-3F ")))
    end = F.when(k % 3 == 0, "_REV2").when(k % 3 == 1, " r03a final").otherwise(" 20240131")
    path = F.concat(F.lit("C:/proj/x/"), begin, F.upper(F.regexp_replace("p_name", " ", "_")), end, F.lit(".dwg"))
    rows = table(spark, sf_dir, "part").select("p_partkey", t.file_identity(path).alias("i"), t.redacted(F.concat(F.lit("see "), path, F.lit(" ok"))).alias("redacted"), t.leaks_path(path).alias("leaks"))
    return rows.select("p_partkey", "i.key", "i.revision", "i.drawing_number", "i.sheet", F.length("redacted").alias("n_redacted"), "leaks")


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text"), 3).alias("w"))
    pairs = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id")
    return pairs.select("doc_id", F.rint(t.jaccard(F.col("w"), F.col("v")) * 1e6).cast("long").alias("jaccard_micro"), F.size("w").cast("long").alias("n_tokens"))


def hash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.substring(F.md5("text"), 1, 16)).alias("h"))
    pairs = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g")), "doc_id")
    return pairs.select("doc_id", (t.hash_similarity(F.col("h"), F.col("g")) * 64).cast("long").alias("page_bits"), (t.hash_similarity(F.col("h"), F.col("g"), both=True) * 64).cast("long").alias("file_bits"))


def mtext_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("{\\fArial|b0;\\H2.5;"), F.col("p_name"), F.lit("\\P%%c"), F.col("p_size").cast("string"), F.lit(" \\S1/2; \\~end}"))
    return table(spark, sf_dir, "part").select("p_partkey", t.mtext(raw).alias("plain"))


def palette_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.colour_hex(F.col("p_size")).alias("colour"), t.unit_mm((F.col("p_partkey") % 8).cast("int")).alias("mm"))


def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return rows.select("p_partkey", F.rint(t.sequence_ratio(t.composed(F.col("p_name")), F.col("p_type")) * 1e6).cast("long").alias("ratio_micro"))


QUERIES = {f.__name__: f for f in (layer_predicates, text_normalised, text_canonical, drawing_number, file_identity, token_jaccard, hash_similarity, mtext_plain, palette_and_units, sequence_ratio)}

_TITLE = r"(?i)(?:^|[-_\s\d])(?:TITLE[_-]?BLOCK|TITLEBLOCK|TITLE|BORDER|DRAWING[_-]?BORDER|DWG[_-]?BORDER|REV|REVISION|REVISION[_-]?BLOCK|STAMP|DRAWING[_-]?FRAME|DWG[_-]?FRAME)(?:$|[-_\s])"
_PAIR = "FROM r JOIN r s ON s.doc_id = r.doc_id + 1"
_BITS = "bit_count(xor(('0x' || r.h)::UBIGINT, ('0x' || s.h)::UBIGINT))"

ORACLE_SQL = {
    "layer_predicates": f"""WITH {_LAYERS} SELECT p_partkey, regexp_matches(layer, '{t.STRUCTURAL}') OR regexp_matches(layer, '{t.STRUCTURAL_KOREAN}') AS structural,
      regexp_matches(layer, '{_TITLE}') OR regexp_matches(layer, '{t.TITLE_KOREAN}') OR layer = 'SHEET-01' AS title_block, layer ILIKE '%TEMP%' OR layer = '0' OR layer ILIKE '_-COL' AS ignored, regexp_replace(layer, '[0-9]+$', '') AS prefix FROM v""",
    "text_normalised": r"""WITH n AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM conversations) SELECT conv_id, turn, role, substring(sha1(lower(p)), 1, 16) AS hash, length(p) AS n_chars FROM n""",
    "text_canonical": """WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'col H_BEAM_' || p_partkey || '_200_8_13 at GRID_B_' || p_size WHEN 1 THEN 'REBAR_13 PLATE_' || p_size || ' DIM_' || p_partkey || '_MM'
      WHEN 2 THEN 'ELEV_PLUS_' || p_partkey || '_5 dwg s20_' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || 'a' ELSE 'FLOOR_B2 DETAIL_' || p_partkey || ' SQR_TUBE_' || p_partkey || '_300 DIM_2_5_M' END AS canonical FROM part) SELECT *, sha256(canonical) AS digest FROM c""",
    "drawing_number": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'S20-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || 'A' WHEN p_partkey % 4 = 1 AND p_size BETWEEN 10 AND 99 AND p_partkey BETWEEN 100 AND 99999 THEN 'PL' || p_size || '-' || p_partkey ELSE '' END AS drawing_number, CASE p_partkey % 4 WHEN 0 THEN 'B' || p_size WHEN 1 THEN 'HD13' WHEN 2 THEN '' ELSE 'B2F' END AS sheet,
      CASE p_partkey % 4 WHEN 0 THEN 'grid' WHEN 1 THEN 'mm' WHEN 2 THEN 'dwg' ELSE 'box' END AS longest FROM part""",
    "file_identity": """WITH v AS (SELECT *, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda w: w NOT IN ('OLD', 'NEW', 'FINAL', 'COPY')), '') AS words, lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS five, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS three FROM part)
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'S2' || p_partkey % 10 || five || words WHEN 1 THEN words ELSE 'AB' || three || '3F' || words END AS key, CASE p_partkey % 3 WHEN 0 THEN 'REV2' WHEN 1 THEN 'R03A' ELSE '' END AS revision,
      CASE p_partkey % 3 WHEN 0 THEN 'S2' || p_partkey % 10 || '-' || five WHEN 2 THEN 'AB' || three ELSE '' END AS drawing_number, CASE p_partkey % 3 WHEN 2 THEN '3F' WHEN 0 THEN 'S2' || p_partkey % 10 ELSE '' END AS sheet,
      CAST(CASE p_partkey % 3 WHEN 0 THEN length('see <path>/s20 00000__REV2.dwg ok') WHEN 1 THEN length('see <path>/ r03a final.dwg ok') ELSE length('see <path>/AB000-3F  20240131.dwg ok') END + length(p_name) AS INT) AS n_redacted, true AS leaks FROM v""",
    "token_jaccard": rf"""WITH r AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]{{3,}}')) AS w FROM documents)
    SELECT r.doc_id, CAST(round_even(CASE WHEN len(r.w) = 0 AND len(s.w) = 0 THEN 0.5 ELSE len(list_intersect(r.w, s.w)) / len(list_distinct(list_concat(r.w, s.w))) END * 1e6, 0) AS BIGINT) AS jaccard_micro, len(r.w) AS n_tokens {_PAIR}""",
    "hash_similarity": f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN substring(md5(text), 1, 16) END AS h FROM documents)
    SELECT r.doc_id, CAST(CASE WHEN r.h IS NULL OR s.h IS NULL THEN 32 ELSE 64 - {_BITS} END AS BIGINT) AS page_bits, CAST(CASE WHEN r.h IS NULL AND s.h IS NULL THEN 32 WHEN r.h IS NULL OR s.h IS NULL THEN 0 ELSE 64 - {_BITS} END AS BIGINT) AS file_bits {_PAIR}""",
    "mtext_plain": "SELECT p_partkey, p_name || ' \u2300' || p_size || ' 1/2 end' AS plain FROM part",
    "palette_and_units": """SELECT p_partkey, CASE p_size WHEN 1 THEN '#FF0000' WHEN 2 THEN '#FFFF00' WHEN 3 THEN '#00FF00' WHEN 4 THEN '#00FFFF' WHEN 5 THEN '#0000FF' WHEN 6 THEN '#FF00FF' WHEN 7 THEN '#FFFFFF' WHEN 8 THEN '#808080' WHEN 9 THEN '#C0C0C0' END AS colour,
      [1.0::DOUBLE, 25.4, 304.8, 1609344, 1, 10, 1000, 1e6][p_partkey % 8 + 1] AS mm FROM part""",
}
