"""Scores, severities and categories of changes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import glob

#: Priority levels (fixed values).
LEVELS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "TRIVIAL": 1}
TYPE_WEIGHT = {"ADDED": 1.0, "DELETED": 1.2, "MODIFIED": 0.9}
REVIEW_BELOW = 0.7


class Profile(NamedTuple):
    name: str
    level: str
    keywords: tuple[str, ...]
    patterns: tuple[str, ...]
    weight: float


#: Layer profiles, the first that fits counts (fixed values).
PROFILES = (
    Profile("structural", "CRITICAL", ("BEAM", "COLUMN", "WALL", "SLAB", "FOUNDATION", "STEEL", "STRUCT"), ("*BEAM*", "*COLUMN*", "*WALL*", "*SLAB*", "*FOUND*", "*STEEL*"), 2.0),
    Profile("dimension", "HIGH", ("DIM", "DIMENSION", "MEASURE", "SIZE", "ANNO"), ("*DIM*", "*DIMENSION*", "*MEAS*"), 1.5),
    Profile("grid", "HIGH", ("GRID", "AXIS", "CENTERLINE", "CL", "BASELINE"), ("*GRID*", "*AXIS*", "*CENTER*"), 1.5),
    Profile("annotation", "MEDIUM", ("TEXT", "NOTE", "LABEL", "TAG", "MARK", "TITLE"), ("*TEXT*", "*NOTE*", "*LABEL*", "*TAG*"), 1.0),
    Profile("reference", "LOW", ("REF", "XREF", "REFERENCE", "BACKGROUND"), ("*REF*", "*XREF*", "*BG*"), 0.7),
    Profile("ignore", "TRIVIAL", ("DEFPOINTS", "TEMP", "HIDDEN", "OLD", "BACKUP"), ("0", "DEFPOINTS", "*TEMP*", "*HIDDEN*", "*_OLD*", "*BACKUP*"), 0.3),
)


def profile(layer: Column, profiles: Sequence[Profile] = PROFILES) -> Column:
    """Struct of the first fitting profile's ``name``, ``level`` (number) and ``weight``; MEDIUM and 1 without one."""
    up = F.upper(F.coalesce(layer, F.lit("")))
    as_struct = lambda n, lv, w: F.struct(F.lit(n).cast("string").alias("name"), F.lit(lv).alias("level"), F.lit(w).alias("weight"))
    out = as_struct(None, LEVELS["MEDIUM"], 1.0)
    for p in reversed(profiles):
        fits = F.rlike(up, F.lit("|".join(p.keywords))) | F.rlike(up, F.lit("|".join(f"(?:{glob(x)})" for x in p.patterns)))
        out = F.when(fits, as_struct(p.name, LEVELS[p.level], p.weight)).otherwise(out)
    return out


def type_weight(change_type: Column) -> Column:
    out = F.lit(1.0)
    for k, v in TYPE_WEIGHT.items():
        out = F.when(F.upper(change_type) == k, v).otherwise(out)
    return out


def priority_score(change_type: Column, found: Column) -> Column:
    """Level times 20, times the weights of type and profile, at most 100."""
    return F.least(F.lit(100.0), found["level"] * 20 * type_weight(change_type) * found["weight"])


def confidence(ocr: Column, match_distance: Column, ssim: Column, layer: Column) -> Column:
    """Blend of recognition, nearness (0 from 20 on), image likeness and layer reliability, to 4 decimals (the even one of two as near)."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    near = F.greatest(F.lit(0.0), 1 - F.greatest(match_distance, F.lit(0.0)) / 20)
    blend = unit(ocr) * 0.30 + near * 0.25 + unit(ssim) * 0.25 + unit(layer) * 0.20
    return F.rint(blend * 1e4) / 1e4  # bround would take the shortest decimal, which is off a tie where the scaled number is on it


def review_reasons(found: Column, ocr: Column, match_distance: Column, ssim: Column, overall: Column) -> Column:
    """Why a change needs a reviewer; empty if it doesn't."""
    checks = [(ocr < REVIEW_BELOW) | (overall < REVIEW_BELOW), match_distance > 10, ssim < REVIEW_BELOW, found["level"] == LEVELS["CRITICAL"]]
    names = ["ocr_low_confidence", "near_match_ambiguous", "visual_difference", "structural_change"]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip(checks, names, strict=True)]))


#: Category of a zone by layer, the first that fits (fixed values): name, pattern, confidence.
ZONE_RULES = (
    ("structural_member", r"(?i)BEAM|COL(?:UMN)?|BRACE|TRUSS|GIRDER|기둥|보|가새|트러스", 0.85),
    ("structural_member", r"(?i)WALL|SLAB|PLATE|FOOTING|FOUNDATION|벽|슬래브|기초", 0.85),
    ("grid", r"(?i)AXIS|GRID|GR_|축선|그리드|XGRID|YGRID", 0.85),
    ("dimension", r"(?i)DIM|DIMS|TXT|TEXT|MTEXT|치수|주석", 0.7),
    ("detail", r"(?i)DETL|DETAIL|MKX|MARK|PCN|SEC|상세|마킹|단면", 0.7),
    ("layer", r"(?i)LAYER|HATCH|LINETYPE|레이어|해치", 0.7),
)
#: Category by entity type when no layer rule fits (fixed values).
ENTITY_RULES = {"TEXT": "dimension", "MTEXT": "dimension", "DIMENSION": "dimension", "INSERT": "detail"}


#: What a category adds to a zone's severity, and its label (fixed values).
ZONE_BOOST = {"structural_member": 10, "grid": 8, "detail": 4, "dimension": 2, "layer": 1}
ZONE_LABELS = {"structural_member": "구조 부재 변경", "grid": "그리드 변경", "dimension": "치수/주석 변경", "detail": "상세/마킹 변경", "layer": "레이어/표기 변경", "other": "기타 변경"}


def zone_boost(category: Column, change_type: Column, n: Column) -> Column:
    """What a zone's category, kind of change and number of changes add to its severity; without a category the number alone."""
    own = F.lit(0)
    for name, value in ZONE_BOOST.items():
        own = F.when(category == name, value).otherwise(own)
    many = F.when(n >= 500, 3).when(n >= 100, 1).otherwise(0)
    return F.when(category == "other", F.floor(n / 50).cast("int")).otherwise(own + F.when(F.lower(change_type).isin("added", "deleted"), 1).otherwise(0) + many)


def zone_label(category: Column) -> Column:
    out = F.lit(ZONE_LABELS["other"])
    for name, value in ZONE_LABELS.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def zone_category(layer: Column, entity: Column) -> Column:
    """Struct of ``category`` and ``confidence``: layer rules, then the entity type, then ``other``."""
    pair = lambda c, v: F.struct(F.lit(c).alias("category"), F.lit(v).alias("confidence"))
    out = pair("other", 0.2)
    for kind, category in ENTITY_RULES.items():
        out = F.when(entity == kind, pair(category, 0.5)).otherwise(out)
    for category, pattern, value in reversed(ZONE_RULES):
        out = F.when(F.rlike(F.coalesce(layer, F.lit("")), F.lit(pattern)), pair(category, value)).otherwise(out)
    return out


def severity(n: Column, n_dimension: Column, n_deleted: Column, n_modified: Column, structural: Column, annotation_move: Column) -> Column:
    """Of a zone's aggregates: moved annotation is low, dimensions critical, structure or 100 changes high."""
    return (
        F.when(annotation_move, "low").when(n_dimension > 0, "critical").when((n >= 100) | structural, "high")
        .when((n >= 10) | (n_deleted > 0) | (n_modified > 0), "medium").otherwise("low")
    )


#: Layers whose changes make a zone severe, entities whose moves alone are layout, categories of mere moves (fixed values).
SEVERE_LAYERS = "BEAM|COLUMN|COL|SLAB|WALL|GRID|FOUND|PILE|BRACE"
ANNOTATION = ("TEXT", "MTEXT", "DIMENSION", "ARC_DIMENSION", "MULTILEADER", "MLEADER", "LEADER", "ATTRIB", "ATTDEF")
POSITION_ONLY = ("position", "layer_move", "cosmetic")


def only_moves(category: Column) -> Column:
    """Whether all of a change's categories (joined by commas; none will do) are of mere moves."""
    return F.forall(F.split(F.lower(F.coalesce(category, F.lit(""))), ","), lambda x: (F.trim(x) == "") | F.trim(x).isin(*POSITION_ONLY))


def moved_origin(change_type: Column, gap: Column, has_old_place: Column, registered: Column) -> Column:
    """Whether a modified change has moved: it has its old place, or its old box (``gap`` away, null without one) is more than 1 off; not if its origin was registered."""
    return F.coalesce((F.lower(change_type) == "modified") & gap.isNotNull() & ~F.coalesce(registered, F.lit(False)) & (has_old_place | (gap > 1.0)), F.lit(False))


def zone_change_type(n_added: Column, n_deleted: Column, n_modified: Column, has_moved: Column) -> Column:
    kinds = F.filter(F.array(F.when(n_added > 0, F.lit("added")), F.when(n_deleted > 0, F.lit("deleted")), F.when(n_modified > 0, F.lit("modified"))), lambda x: x.isNotNull())
    return F.when(has_moved, "moved").when(F.size(kinds) == 1, F.get(kinds, 0)).otherwise("mixed")


def noise_score(n: Column, cosmetic: Column, micro: Column, structural: Column) -> Column:
    """0.3 for a single change, 0.3 if all are cosmetic, 0.2 if all are tiny, 0.2 without structure."""
    return F.when(n == 1, 0.3).otherwise(0.0) + F.when(cosmetic, 0.3).otherwise(0.0) + F.when(micro, 0.2).otherwise(0.0) + F.when(structural, 0.0).otherwise(0.2)


#: Terms of the dashboard's score (fixed values).
SEVERITY_SCORE = {"critical": 420.0, "high": 320.0, "medium": 180.0, "low": 80.0}
CATEGORY_SCORE = {"rebar": 720.0, "member": 680.0, "mixed": 620.0, "dimension": 560.0, "grid": 520.0}


def lookup(value: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def dashboard_score(severity_: Column, raw: Column, added: Column, deleted: Column, modified: Column, area: Column, structural: Column, category: Column, content: Column, exact: Column, folded: Column) -> Column:
    """Sum of the terms of severity, size, area, mix, modification, structure, category, content and exactness; less for folded ones."""
    kinds = (added > 0).cast("int") + (deleted > 0).cast("int") + (modified > 0).cast("int")
    total = (
        lookup(severity_, SEVERITY_SCORE, 120.0) + F.least(raw.cast("double"), F.lit(1000.0)) * 0.22 + F.least(F.sqrt(F.greatest(area, F.lit(0.0))), F.lit(2500.0)) * 0.04
        + F.when(kinds >= 2, 40.0).otherwise(0.0) + F.least(modified.cast("double"), F.lit(100.0)) * 0.6 + F.when(structural, 70.0).otherwise(0.0)
        + lookup(category, CATEGORY_SCORE, 0.0) + F.when(content, 220.0).otherwise(0.0) + F.when(exact, 35.0).otherwise(0.0)
    )
    return total * F.when(~folded, 1.0).when(category.isin(*CATEGORY_SCORE), 0.75).otherwise(0.45)


#: Words and marks of structural categories (fixed values).
REBAR_MARK = r"(?iU)(?:S?H?D|HD|SD|D)\s*\d{1,3}\s*@\s*\d{2,4}|[\u03A6\u00D8]\s*\d{1,3}\s*@\s*\d{2,4}"
MEMBER_WORDS = r"(?iU)\b(?:BEAM|COLUMN|GIRDER|BRACE|SLAB|WALL)\b|H[-\s]?\d{2,4}\s*[xX]\s*\d{2,4}|기둥|보|슬래브|벽체|부재"
GRID_WORDS = r"(?iU)\b(?:GRID|AXIS)\b|그리드|축선|기준선"
DIMENSION_WORDS = r"(?iU)\b\d{2,5}(?:\.\d+)?\s*(?:mm|m)?\b|\bDIM(?:ENSION)?\b|치수"


def dimension_like(text: Column, layers: Column, entities: Column, change_type: Column, content_changed: Column) -> Column:
    """Whether a change is one of dimensions: by entity, layer or kind of change, or by words where the content changed."""
    named = F.contains(F.upper(entities), F.lit("DIMENSION")) | F.contains(F.upper(layers), F.lit("DIM")) | F.lower(change_type).isin("dimension", "dimension_modified")
    return F.coalesce(named, F.lit(False)) | (F.rlike(text, F.lit(DIMENSION_WORDS)) & content_changed)


def structural_category(text: Column, dimension_like: Column) -> Column:
    """rebar, member, grid or dimension by words; mixed for several, other for none."""
    rebar, member, grid = (F.rlike(text, F.lit(p)) for p in (REBAR_MARK, MEMBER_WORDS, GRID_WORDS))
    found = F.array_compact(F.array(F.when(rebar, F.lit("rebar")), F.when(member, F.lit("member")), F.when(grid, F.lit("grid")), F.when(~rebar & dimension_like, F.lit("dimension"))))
    return F.when(F.size(found) > 1, "mixed").otherwise(F.coalesce(F.get(found, 0), F.lit("other")))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of equal length, in double precision; null if one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def map_cosine(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two maps of counts; ``empty`` if both have none, 0 if one has none."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dot = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), empty).otherwise(F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0)))


#: Prototypes that every item is held against.
MOST_PROTOTYPES = 10_000


def by_prototypes(items: DataFrame, prototypes: DataFrame, id_col: str, vector: str, category: str, threshold: float, margin: float) -> DataFrame:
    """Category of each item by its most similar prototype, or null below the threshold or the margin to the next category.

    ``prototypes`` is a model: a few vectors a category, ``MOST_PROTOTYPES`` at most, which are broadcast.
    """
    if prototypes.count() > MOST_PROTOTYPES:
        raise ValueError("prototypes are broadcast and have a bounded number")
    prototypes = F.broadcast(prototypes)
    pairs = items.select(id_col, F.col(vector).alias("v")).crossJoin(prototypes.select(category, F.col(vector).alias("p")))
    best = pairs.groupBy(id_col, category).agg(F.max(cosine(F.col("v"), F.col("p"))).alias("similarity"))
    w = Window.partitionBy(id_col).orderBy(F.desc("similarity"), category)
    rows = best.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("similarity").over(w)).filter("rank = 1")
    sure = (F.col("similarity") >= threshold) & (F.col("similarity") - F.coalesce("next", F.lit(-1.0)) >= margin)
    return rows.select(id_col, F.when(sure, F.col(category)).alias("category"), "similarity", F.coalesce("next", F.lit(-1.0)).alias("runner_up"))
