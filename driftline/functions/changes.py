"""What differs between two matched records, and whether it matters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.geometry import angle_delta, distance
from driftline.functions.text import is_structural


@dataclass(frozen=True)
class Sensitivity:
    """Thresholds of significance (fixed values of the reference and its presets)."""

    position: float = 1.0
    structural: float = 0.1
    dimension: float = 1.0
    dimension_rel: float = 0.001
    rotation: float = 0.1
    scale: float = 0.01
    radius: float = 10.0

    @classmethod
    def preset(cls, name: str) -> Sensitivity:
        if name == "strict":
            return cls(position=0.1, dimension=0.1, dimension_rel=0.0001, rotation=0.01, scale=0.001, radius=5.0)
        if name == "relaxed":
            return cls(position=5.0, dimension=5.0, dimension_rel=0.01, rotation=1.0, scale=0.05, radius=20.0)
        return cls()

    @classmethod
    def from_yaml(cls, text: str) -> Sensitivity:
        """Settings of a document's ``sensitivity`` mapping over its ``preset``; unknown names do not count."""
        import yaml

        own = (yaml.safe_load(text) or {}).get("sensitivity") or {}
        known = {k: float(v) for k, v in own.items() if k in cls.__dataclass_fields__}
        return replace(cls.preset(str(own.get("preset", "normal"))), **known)

    def position_limit(self, layer: Column) -> Column:
        return F.when(is_structural(layer), self.structural).otherwise(self.position)

    def dimension_significant(self, old: Column, new: Column) -> Column:
        """By the absolute or by the relative threshold."""
        d = F.abs(new - old)
        return (d >= self.dimension) | F.coalesce(d / F.nullif(F.abs(old), F.lit(0.0)) >= self.dimension_rel, F.lit(False))

    def rotation_significant(self, old: Column, new: Column) -> Column:
        return angle_delta(old, new) >= self.rotation

    def scale_significant(self, old: Column, new: Column) -> Column:
        return F.when(old == 0, new != 0).otherwise(F.abs(new - old) / F.abs(old) >= self.scale)


def categories(s: Sensitivity, kind: Column, layer: Column, moved: Column, old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Names of what changed, in a fixed order; ``content`` if nothing else did.

    ``old`` and ``new`` have ``measure rotation scale content``.
    """
    checks = {
        "position": moved >= s.position_limit(layer),
        "dimension": (kind == "DIMENSION") & s.dimension_significant(old["measure"], new["measure"]),
        "rotation": s.rotation_significant(old["rotation"], new["rotation"]),
        "scale": (kind == "INSERT") & s.scale_significant(old["scale"], new["scale"]),
        "content": kind.isin("TEXT", "MTEXT", "ATTRIB", "ATTDEF", "INSERT") & ~old["content"].eqNullSafe(new["content"]),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("content"))).otherwise(found)


def significant(names: Column, moved: Column, limit: Column) -> Column:
    """The intended filter: only a position change below the limit is left out. (In the reference it never rejects.)"""
    return ~((names == F.array(F.lit("position"))) & (moved < limit))


def alignment_artifact(dx: Column, dy: Column, shift_x: Column, shift_y: Column, inliers: Column, limit: Column, strict: float = 0.85) -> Column:
    """A displacement that the global shift (new to old) explains, if that shift is well supported."""
    return (inliers >= strict) & (F.abs(dx + shift_x) < limit) & (F.abs(dy + shift_y) < limit)


def line_distance(a: list[Column], b: list[Column]) -> Column:
    """Largest move of an end, whichever way the line was drawn; a and b are x0 y0 x1 y1."""
    straight = F.greatest(distance(a[0], a[1], b[0], b[1]), distance(a[2], a[3], b[2], b[3]))
    crossed = F.greatest(distance(a[0], a[1], b[2], b[3]), distance(a[2], a[3], b[0], b[1]))
    return F.least(straight, crossed)


def polyline_diffs(a: Column, b: Column, tolerance: float) -> Column:
    """Struct of equal vertex count and, if so, how many vertices moved and how far at most; arrays of structs x, y."""
    moves = F.zip_with(a, b, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))
    same = F.size(a) == F.size(b)
    return F.struct(same.alias("same_count"), F.when(same, F.size(F.filter(moves, lambda d: d > tolerance))).alias("moved"), F.when(same, F.coalesce(F.array_max(moves), F.lit(0.0))).alias("farthest"))


#: Layer words and marks of structural drawings (fixed values); the case of letters counts in notes only.
STRUCTURE_HINTS = (
    "BEAM", "COLUMN", "COL", "BRACE", "GIRDER", "TRUSS", "WALL", "SLAB", "FOOTING", "FOUNDATION", "PILE", "FRAME", "GRID", "AXIS", "SECTION", "DETAIL", "SEC", "DIM", "BM_", "CL_", "GR_", "WL_", "FT_",
    "구조", "기둥", "보", "벽", "슬래브", "기초", "철근", "배근", "단면", "상세", "그리드", "축선",
)
GRID_HINTS = ("GRID", "GRD", "AXIS", "그리드", "축선")
GRID_MARK = r"\bGRID[-_ ]?[A-Z0-9]+(?:[-_ ][A-Z0-9]+)?\b"
GRID_LABEL = r"(?:[A-Z]{1,3}[-_ ]?)?\d+[A-Z]?|[A-Z]{1,3}[-_ ]?\d+[A-Z]?"
MEMBER_MARK = (
    r"\b(?:COLUMN|COL|BEAM|GIRDER|BRACE|SLAB|WALL|FOOTING|PILE)\s+[A-Z]{0,3}\d+[A-Z]?\b|\b(?:C|B|G|BM|CL|BR|W|F)[-_ ]?\d+[A-Z]?\b|\bH[-_ ]?\d+X\d+\b"
    r"|(?:기둥|보|벽체|벽|슬래브|바닥|기초|파일|말뚝|브레이스)\s*[A-Z]{0,3}[-_ ]?\d+[A-Z]?"
)
SECTION_MARK = r"\b(?:SEE\s+)?S[-_ ]?\d{2,4}(?:[/.-][A-Z0-9]+)?\b|\b(?:SECTION|DETAIL|REF(?:ERENCE)?)\b|(?:상세|단면|참조)\s*S[-_ ]?\d{2,4}(?:[/.-][A-Z0-9]+)?|(?:상세|단면|참조)"
NOTE_MARK = r"\b(?:NOTE|GENERAL\s+NOTE|REMARK)\b|(?:주기|일반사항|비고)"
DIMENSION_MARK = r"\b\d+(?:\.\d+)?\s*(?:MM|M)?\b"


def _hinted(layer: Column, hints: tuple[str, ...]) -> Column:
    up = F.upper(F.coalesce(layer, F.lit("")))
    return reduce(lambda x, y: x | y, [F.contains(up, F.lit(h)) for h in hints])


def domain_matches(text: Column, entity: Column, layer: Column) -> Column:
    """Distinct marks of a text, its entity type and its layer, by rule and place: structs of kind, value, confidence."""
    text = F.coalesce(text, F.lit(""))
    row = lambda kind, value, sure: F.struct(F.lit(kind).alias("kind"), F.trim(value).alias("value"), F.lit(sure).alias("confidence"))
    marks = lambda kind, pattern, sure: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: row(kind, v, sure))
    none = F.array().cast("array<struct<kind:string,value:string,confidence:string>>")
    only = lambda test, found: F.when(test, found).otherwise(none)
    whole = lambda pattern: F.rlike(F.trim(text), F.lit(rf"(?iU)^(?:{pattern})$"))
    like_dimension = whole(DIMENSION_MARK) | F.contains(F.upper(F.coalesce(layer, F.lit(""))), F.lit("DIM"))
    is_dimension = F.coalesce(entity == "dimension", F.lit(False))
    found = F.concat(
        marks("grid", f"(?iU){GRID_MARK}", "high"), only(_hinted(layer, GRID_HINTS) & whole(GRID_LABEL), F.array(row("grid", text, "medium"))),
        marks("member_tag", f"(?iU){MEMBER_MARK}", "high"), marks("section_reference", f"(?iU){SECTION_MARK}", "high"), marks("note", f"(?U){NOTE_MARK}", "medium"),
        only(is_dimension, F.array(row("dimension", text, "high"))), only(~is_dimension & like_dimension, marks("dimension", f"(?iU){DIMENSION_MARK}", "medium")),
        only(_hinted(layer, STRUCTURE_HINTS), F.array(row("structural_layer", F.coalesce(layer, F.lit("")), "medium"))),
    )
    return F.array_distinct(F.filter(found, lambda x: x["value"] != ""))


def domain_tags(text: Column, entity: Column, layer: Column) -> Column:
    """Distinct kinds of the marks, in rule order."""
    return F.array_distinct(F.transform(domain_matches(text, entity, layer), lambda x: x["kind"]))


#: What a compact output (JSON) must not hold (fixed values).
RAW_KEYS = ("canonical_drawing", "normalized_drawing", "raw_drawing", "raw_payload", "raw_entities", "raw_entity", "modelspace", "paperspace")
SECRET_LIKE = r"(?iU)\b(api[_-]?key|secret|password|passwd|token)\b\s*[:=]\s*['\"]?[^'\"\s]{8,}"
ACTION_PHRASES = ("approved", "released", "send now", "submit now", "can proceed", "approval granted", "release is allowed")
ALL_CLEAR_PHRASES = ("no issues found", "no issue found", "no problems found", "all clear", "nothing to review")
BAD_HEALTH = ("partial", "unsupported", "failed", "missing", "timeout", "error")
#: Where an output speaks to its reader (fixed values).
ANSWERS = ("$.summary.answer", "$.draft.subject", "$.draft.body", "$.draft.review_checklist", "$.draft.limitations", "$.issue_suggestions[*].title", "$.issue_suggestions[*].rationale", "$.issue_suggestions[*].next_action")


def safety_findings(payload: Column) -> Column:
    """Codes of what a JSON output holds that it must not, a code for each key, secret and phrase: raw keys, secrets, words of action, a bad source called all clear."""
    at = lambda path: F.coalesce(F.get_json_object(payload, path), F.lit(""))
    code = lambda name, values: F.transform(values, lambda _: F.lit(name))
    names = F.transform(F.regexp_extract_all(payload, F.lit(r'"((?:[^"\\]|\\.)*+)"\s*:'), F.lit(1)), F.lower)
    said = F.lower(F.concat_ws("\n", *[at(p) for p in ANSWERS]))
    held = lambda phrases, text: F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))
    health = F.lower(F.coalesce(F.nullif(at("$.source.source_health"), F.lit("")), at("$.basis.source_health")))
    calm = F.when(health.isin(*BAD_HEALTH), F.slice(held(ALL_CLEAR_PHRASES, F.lower(F.concat_ws(" ", at("$.summary.answer"), at("$.draft.body")))), 1, 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        code("raw_payload_key", F.filter(names, lambda n: n.isin(*RAW_KEYS))), code("secret_like_marker", F.regexp_extract_all(payload, F.lit(SECRET_LIKE), F.lit(0))),
        code("positive_action_language", held(ACTION_PHRASES, said)), code("source_health_misleading_answer", calm),
    )


#: Rendering tiers: dots an inch, longest edge in pixels, MB for a pair, from the finest; load by the MB of the largest pair (fixed values).
TIERS = ((300, 8000, 1100.0), (200, 6000, 600.0), (120, 3600, 250.0), (80, 2400, 120.0))
LOADS = ((25, 1.0), (100, 1.5), (300, 2.5))
MOST_LOAD, MARGIN = 4.0, 0.6


def quality_tier(pair_mb: Column, files: Column, cap_mb: Column, margin: float = MARGIN) -> Column:
    """Struct of the finest tier whose projected memory fits the budget, else of the coarsest, and whether it ``fits``."""
    load = F.lit(MOST_LOAD)
    for most, value in reversed(LOADS):
        load = F.when(pair_mb <= most, value).otherwise(load)
    fits = lambda mb: load * mb * (1 + files / 100) <= cap_mb * min(max(margin, 0.1), 1.0)
    of = lambda tier, ok: F.struct(F.lit(tier[0]).alias("dpi"), F.lit(tier[1]).alias("max_edge_px"), ok.alias("fits"))
    out = of(TIERS[-1], fits(TIERS[-1][2]))
    for tier in reversed(TIERS[:-1]):
        out = F.when(fits(tier[2]), of(tier, F.lit(True))).otherwise(out)
    return out


def localised_status(kind: Column, before: Column, after: Column, match: Column) -> Column:
    """Status of a zone by its kind, the regions of its two sides and the status of their match."""
    both = before.isNotNull() & after.isNotNull()
    return (
        F.when(kind == "added", F.when(after.isNotNull(), "added_in_after_region").otherwise("unassigned"))
        .when(kind == "deleted", F.when(before.isNotNull(), "deleted_from_before_region").otherwise("unassigned"))
        .when(both & (match == "review_required"), "matched_region_review_required").when(both & match.isNotNull(), "matched_region_change").when(both, "cross_region_or_unmatched_detail")
        .when(before.isNotNull(), "before_region_only").when(after.isNotNull(), "after_region_only").otherwise("unassigned")
    )
