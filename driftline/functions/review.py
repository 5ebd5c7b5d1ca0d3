"""Review of changes and evidence: category by words, priority, anchors, and the text of a draft."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.changes import STRUCTURE_HINTS, _hinted, domain_matches, domain_tags
from driftline.functions.text import canonical, let

#: Categories by layer words, by words of a text, and by entity type, in order (fixed values).
LAYER_WORDS = (
    ("text_label", r"(?iU)(?:^|_)(?:TEXT|LABEL|TXT|MTEXT|NOTE|REMARK|주기|텍스트)(?:$|_)"),
    ("dimension", r"(?iU)(?:^|_)(?:DIM|DIMENSION|치수)(?:$|_)"),
    ("grid", r"(?iU)(?:^|_)(?:GRID|AXIS|그리드|축선)(?:$|_)"),
    ("detail_drawing", r"(?iU)(?:^|_)(?:DETAIL|SECTION|상세|단면)(?:$|_)"),
    ("structural_member", r"(?iU)(?:^|_)(?:BEAM|COLUMN|SLAB|WALL|FOOTING|FOUNDATION|GIRDER|JOIST|PILE|보|기둥|슬래브|벽체|기초)(?:$|_)"),
)
TEXT_WORDS = (
    ("structural_member", r"(?U)H\d|□\d|HSS|H[-_ ]?BEAM|보|GIRDER|JOIST"),
    ("structural_member", r"(?U)기둥|COLUMN|COL\d|HSS|PIPE"),
    ("grid", r"(?U)^\s*[XY]\d+\s*$|GRID|AXIS"),
    ("dimension", r"(?U)\b\d{2,5}\s*mm\b|\bDIM\b|치수"),
    ("note", r"(?U)NOTE|주기|REMARK|일반사항"),
)
ENTITY_CATEGORY = {
    "TEXT": "text_label", "MTEXT": "text_label", "PDF_TEXT": "text_label", "DIMENSION": "dimension", "ALIGNED_DIMENSION": "dimension", "ROTATED_DIMENSION": "dimension", "LINE": "structural_member",
    "LWPOLYLINE": "structural_member", "POLYLINE": "structural_member", "CIRCLE": "structural_member", "ARC": "structural_member", "INSERT": "structural_member", "HATCH": "detail_drawing", "LEADER": "note", "MULTILEADER": "note",
}
#: Severity of a category, and what a reviewer does by severity (fixed values).
CATEGORY_SEVERITY = {"structural_member": "critical", "grid": "critical", "text_label": "minor", "note": "minor"}
SEVERITY_ACTION = {"critical": "review", "normal": "review", "minor": "confirm"}


def _first(rules: Sequence[tuple[str, str]], text: Column) -> Column:
    return let(text, lambda t: F.coalesce(*[F.when(F.rlike(t, F.lit(p)), F.lit(c)) for c, p in rules]))


def keyword_category(layer: Column, entity: Column, text: Column) -> Column:
    """Struct of ``category``, ``severity``, ``confidence``, ``action`` by words of the layer, then of the text, then by the entity type.

    Words are looked for in the canonical form. A text that agrees with its layer adds to the confidence.
    """
    kind, by_entity = F.upper(F.coalesce(entity, F.lit(""))), F.lit(None).cast("string")
    for k, v in ENTITY_CATEGORY.items():
        by_entity = F.when(kind == k, v).otherwise(by_entity)
    found = F.struct(_first(LAYER_WORDS, canonical(layer)).alias("layer"), _first(TEXT_WORDS, canonical(text)).alias("text"), by_entity.alias("entity"))
    page = F.startswith(F.coalesce(layer, F.lit("")), F.lit("PDF_PAGE_"))
    return let(found, lambda f: _judged(f["layer"], f["text"], f["entity"], page))


def _judged(by_layer: Column, by_text: Column, by_entity: Column, page: Column) -> Column:
    category = F.coalesce(by_layer, by_text, by_entity, F.lit("unknown"))
    confidence = F.when(by_layer.isNotNull() & (by_layer == by_text), 0.95).when(by_layer.isNotNull(), 0.85).when(by_text.isNotNull(), 0.75).when(by_entity.isNotNull(), 0.55).otherwise(0.3)
    severity = F.lit("normal")
    for k, v in CATEGORY_SEVERITY.items():
        severity = F.when(category == k, v).otherwise(severity)
    severity = F.when(page, "minor").otherwise(severity)
    return F.struct(category.alias("category"), severity.alias("severity"), confidence.alias("confidence"), F.when(severity == "minor", "confirm").otherwise("review").alias("action"))


#: Priority by entity type where the layer says nothing (fixed values).
ENTITY_PRIORITY = {"DIMENSION": "high", "INSERT": "high", "HATCH": "low", "POINT": "low"}


def priority_class(layer_value: Column, entity: Column) -> Column:
    """critical, high, medium or low by a layer's priority (2 critical, 1 ordinary, 0 low, -1 ignored) and the entity type."""
    by_entity = F.lit("medium")
    for k, v in ENTITY_PRIORITY.items():
        by_entity = F.when(entity == k, v).otherwise(by_entity)
    return F.when((layer_value == 2) & (entity == "DIMENSION"), "critical").when(layer_value == 2, "high").when(layer_value.isin(0, -1), "low").otherwise(by_entity)


#: What reads like a reference or a member's mark (fixed values).
REFERENCE = r"\b[A-Z]{1,4}[-_]?\d+[A-Z]?\b|\bS[-_]?\d{2,4}\b"


def anchor_score(text: Column, entity: Column, layer: Column, keywords: Sequence[str]) -> Column:
    """How relevant a text anchor is: keywords, entity type, layer, domain marks, reference notation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.contains(low, F.lit(w.casefold())).cast("int") for w in keywords), F.lit(0))
    found = domain_matches(text, entity, layer)
    bonus = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    section = F.exists(found, lambda x: x["kind"] == "section_reference")
    return (
        1.0 + F.least(F.lit(8.0), hits * 3.0) + bonus(entity.isin("dimension", "block_reference"), 1.25) + bonus(_hinted(layer, STRUCTURE_HINTS), 0.75) + bonus(F.size(domain_tags(text, entity, layer)) > 0, 1.0)
        + bonus(F.exists(found, lambda x: x["confidence"] == "high"), 0.75) + bonus(F.rlike(F.upper(text), F.lit(REFERENCE)) | section, 0.75)
    )


def anchor_confidence(score: Column, parsed: Column) -> Column:
    return F.when(~parsed, F.when(score < 5, "low").otherwise("medium")).when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")


def change_evidence(changes, most: int | None = None):
    """Changes (``id change_type entity_type layer text x0 y0 x1 y1``) as evidence: number, tags and centre; unchanged ones are none.

    ``most`` keeps the first by id, as a report does; without it all are kept.
    """
    rows = changes.filter("change_type <> 'unchanged'")
    if most is not None:
        rows = rows.orderBy("id").limit(most)
    tags = domain_tags(F.col("text"), F.col("entity_type"), F.col("layer"))
    centre = lambda p, q: (F.col(p) + F.col(q)) / 2
    return rows.select("id", F.concat(F.lit("chg-"), F.col("id").cast("string")).alias("evidence_id"), "change_type", "entity_type", "layer", F.col("text").alias("anchor_text"), tags.alias("domain_tags"), centre("x0", "x1").alias("cx"), centre("y0", "y1").alias("cy"))


#: Kinds of drafts and their subjects (fixed values).
SUBJECTS = {"review_note": "Structural Drawing Review Note", "rfi_reply": "Structural Drawing RFI Reply Draft", "checklist_findings": "Structural Drawing Checklist Findings"}


def drafts(evidence, by: str, kind: str = "review_note", most: int = 30):
    """One draft text for each value of ``by``: the subject, the number of pieces of evidence, and the first of them.

    The pieces in the text are its first ``most``, as a letter has room for; the count is of all.
    """
    from pyspark.sql import Window

    if kind not in SUBJECTS:
        raise ValueError(f"unsupported draft type: {kind}")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("id"))
    line = F.concat(F.lit("- ["), F.col("evidence_id"), F.lit("] "), F.coalesce("anchor_text", F.lit("")))
    counts = evidence.groupBy(by).agg(F.count("*").alias("n_evidence"))
    lines = evidence.withColumn("_r", rank).filter(F.col("_r") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return counts.join(lines, by).select(by, F.lit(SUBJECTS[kind]).alias("subject"), "n_evidence", body.alias("body"))
