"""Regions of a sheet and pairs of pages: clusters and viewports as regions, their identity, manual decisions, assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import area, box
from driftline.functions.keys import LINES, looks_structural, table_reasons, table_word
from driftline.operators.assign import optimal
from driftline.operators.pairing import AUTO, REVIEW, status, unmatched
from driftline.operators.regions import suppressed
from driftline.operators.zones import clusters

#: Gap of a sheet's clusters as a share of its diagonal, and at least; entities of a region; overlap that makes viewports one (fixed values).
GAP_SHARE, LEAST_GAP, LEAST_ENTITIES, MOST_ENTITIES, ENTITY_SHARE, SAME_VIEWPORT = 0.035, 100.0, 3, 12, 60, 0.85
#: Share of a region's height and width that its title stands in, texts of a title, its length (fixed values).
TITLE_HEIGHT, TITLE_WIDTH, TITLE_TEXTS, TITLE_LENGTH = 0.25, 0.35, 8, 240
TITLE_KINDS = ("TEXT", "MTEXT", "ATTRIB", "ATTDEF", "INSERT")
#: Drawing numbers in a region's texts, in order (fixed values).
NUMBERS = (r"(?i)(?<![A-Z0-9])([A-Z]{1,4}[0-9]{2})[-_. ]+([0-9]{3,5}[A-Z]?)(?![A-Z0-9])", r"(?i)\b[A-Z]{1,4}[-_]?\d{1,4}(?:[-_][A-Z0-9]{1,6})?\b", r"(?i)\b\d{1,4}[-_][A-Z]{1,4}[-_]?\d{1,4}\b")


def _around() -> list[Column]:
    """Counts and the box of entities (``kind layer text block box``)."""
    return [
        F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"), F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("n_text"),
        F.count_if(F.upper("kind").isin(*LINES)).alias("n_line"), F.count_if(looks_structural(F.col("layer"), F.col("kind"))).alias("n_structural"), F.bool_or(table_word(F.col("layer"), F.coalesce("text", F.lit("")), F.coalesce("block", F.lit("")))).alias("named"),
    ]


def _rejected(whole_area: Column) -> Column:
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return table_reasons(F.col("n"), F.col("n_text"), F.col("n_line"), F.col("n_structural"), F.col("named"), own, whole_area)


def cluster_regions(entities: DataFrame, sheet: str, most: int | None = None) -> DataFrame:
    """Clusters of a sheet's entities as regions, by (y, x), without those that look like tables.

    ``entities`` has ``id kind layer text block box``. Entities are linked over gaps of a share of the
    sheet's diagonal; a region has a number of entities that grows with the sheet. ``most``
    takes the first of a sheet, before tables are rejected; without it all are kept.
    """
    whole = entities.groupBy(sheet).agg(F.min("box.x0").alias("wx0"), F.min("box.y0").alias("wy0"), F.max("box.x1").alias("wx1"), F.max("box.y1").alias("wy1"), F.count("*").alias("total"))
    w, h = F.col("wx1") - F.col("wx0"), F.col("wy1") - F.col("wy0")
    whole = whole.select(sheet, "total", (w * h).alias("whole"), F.greatest(F.sqrt(w * w + h * h) * GAP_SHARE, F.lit(LEAST_GAP)).alias("gap"))
    rows = entities.join(whole, sheet)
    part = lambda k: F.col(f"box.{k}") / F.col("gap")
    of = clusters(rows.select(sheet, "id", box(part("x0"), part("y0"), part("x1"), part("y1")).alias("box")), 1.0, 4.0, [sheet])
    held = rows.join(of.select("id", "zone").hint("merge"), "id").groupBy(sheet, "zone").agg(*_around(), F.first("whole").alias("whole"), F.first("total").alias("total"))
    least = F.greatest(F.lit(LEAST_ENTITIES), F.least(F.lit(MOST_ENTITIES), F.floor(F.col("total") / ENTITY_SHARE)))
    held = held.filter((F.col("n") >= least) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    if most is not None:
        held = held.withColumn("_r", F.row_number().over(Window.partitionBy(sheet).orderBy("y0", "x0", "zone"))).filter(F.col("_r") <= most).drop("_r")
    return held.filter(F.size(_rejected(F.col("whole"))) == 0).select(sheet, F.col("zone").alias("region"), "n", "x0", "y0", "x1", "y1")


def viewport_regions(entities: DataFrame, viewports: DataFrame, sheet: str, cell: float) -> DataFrame:
    """Viewports (``id box``) as regions: none that looks like a table by what has its centre in it, and of those that overlap almost wholly the largest."""
    inside = viewports.select(sheet, F.col("id").alias("view"), F.col("box").alias("frame")).join(entities, sheet)
    cx, cy = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    inside = inside.filter(cx.between(F.col("frame.x0"), F.col("frame.x1")) & cy.between(F.col("frame.y0"), F.col("frame.y1")))
    counts = inside.groupBy(sheet, F.col("view").alias("id")).agg(*_around())
    whole = entities.groupBy(sheet).agg(((F.max("box.x1") - F.min("box.x0")) * (F.max("box.y1") - F.min("box.y0"))).alias("whole"))
    own = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    rows = viewports.filter(area(F.col("box")) > 0).join(counts.drop("x0", "y0", "x1", "y1"), [sheet, "id"], "left").join(whole, sheet, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reasons = table_reasons(zero("n"), zero("n_text"), zero("n_line"), zero("n_structural"), F.coalesce("named", F.lit(False)), own, F.greatest(F.coalesce("whole", F.lit(0.0)), own))
    kept = rows.filter(F.size(reasons) == 0).select(sheet, "id", "box")
    return suppressed(kept, [sheet], cell, SAME_VIEWPORT).select(sheet, "id")


def title_bands(frame: Column) -> list[Column]:
    """The parts of a region that its title stands in: its foot and its right side."""
    h, w = frame["y1"] - frame["y0"], frame["x1"] - frame["x0"]
    return [box(frame["x0"], frame["y0"], frame["x1"], frame["y0"] + h * TITLE_HEIGHT), box(frame["x1"] - w * TITLE_WIDTH, frame["y0"], frame["x1"], frame["y1"])]


def region_number(text: Column) -> Column:
    """The drawing number in a text by the first pattern that fits, in upper case; null without one."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in NUMBERS]))


def region_identity(texts: DataFrame, region: str) -> DataFrame:
    """Title and drawing number of each region from the texts in its title bands, or without any from all its texts.

    ``texts`` has ``ordinal kind text box frame``. A number that the bands lack is looked for in all texts.
    """
    cx, cy = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    bands = [cx.between(b["x0"], b["x1"]) & cy.between(b["y0"], b["y1"]) for b in title_bands(F.col("frame"))]
    rows = texts.filter(F.upper("kind").isin(*TITLE_KINDS) & (F.trim("text") != "")).select(region, "ordinal", F.trim("text").alias("text"), (bands[0] | bands[1]).alias("banded"))
    rows = rows.withColumn("number", region_number(F.col("text"))).withColumn("any", F.bool_or("banded").over(Window.partitionBy(region)))
    source = F.col("banded") | ~F.col("any")
    rank = F.row_number().over(Window.partitionBy(region, source).orderBy("ordinal"))
    rows = rows.withColumn("source", source).withColumn("_r", rank)
    first = lambda test: F.min(F.when(test & F.col("number").isNotNull(), F.struct("ordinal", "number")))["number"]
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("source") & (F.col("_r") <= TITLE_TEXTS), F.struct("_r", "text")))), lambda x: x["text"]), " | ")
    return rows.groupBy(region).agg(F.substring(title, 1, TITLE_LENGTH).alias("title"), F.coalesce(first(F.col("source")), first(F.lit(True)), F.lit("")).alias("number"), F.bool_or("any").alias("from_title"))


def region_overrides(overrides: DataFrame, before: DataFrame, after: DataFrame, pair: str) -> DataFrame:
    """Manual decisions about regions in their order, each with an ``error`` or null if it holds.

    ``overrides`` has ``pair ordinal status before_id after_id`` (manual_match, unmatched_before,
    unmatched_after); ``before`` and ``after`` have ``pair id``. Unknown regions and statuses are
    errors, and so is a region that an earlier decision without an error of its own takes:
    the first decision wins.
    """
    known = lambda df, c: df.select(pair, F.col("id").alias(c), F.lit(True).alias(f"_{c}"))
    rows = overrides.join(known(before, "before_id"), [pair, "before_id"], "left").join(known(after, "after_id"), [pair, "after_id"], "left")
    needs = {"manual_match": ("before_id", "after_id"), "unmatched_before": ("before_id",), "unmatched_after": ("after_id",)}
    base = F.lit("unsupported status")
    for name, ends in needs.items():
        missing = [F.col(f"_{e}").isNull() for e in ends]
        base = F.when(F.col("status") == name, F.when(missing[0] | missing[-1], "unknown region")).otherwise(base)
    rows = rows.withColumn("_base", base)
    uses = lambda end: F.when(F.col("_base").isNull() & F.col("status").isin(*[n for n, ends in needs.items() if end in ends]), F.col(end))
    rows = rows.withColumn("_b", uses("before_id")).withColumn("_a", uses("after_id"))
    # a decision holds if no earlier one that holds shares a region: those of a pair are few, and walked in order
    acc = F.struct(F.array().cast("array<string>").alias("b"), F.array().cast("array<string>").alias("a"), F.array().cast("array<bigint>").alias("bad"))

    def step(state: Column, x: Column) -> Column:
        clash = F.coalesce(F.array_contains(state["b"], x["b"]), F.lit(False)) | F.coalesce(F.array_contains(state["a"], x["a"]), F.lit(False))
        put = lambda held, v: F.when(clash | v.isNull(), held).otherwise(F.concat(held, F.array(v)))
        return F.struct(put(state["b"], x["b"]).alias("b"), put(state["a"], x["a"]).alias("a"), F.when(clash, F.concat(state["bad"], F.array(x["ordinal"]))).otherwise(state["bad"]).alias("bad"))

    listed = F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("_b").cast("string").alias("b"), F.col("_a").cast("string").alias("a"))))
    bad = rows.groupBy(pair).agg(F.aggregate(listed, acc, step)["bad"].alias("_bad"))
    error = F.coalesce(F.col("_base"), F.when(F.array_contains("_bad", F.col("ordinal").cast("long")), "conflicts with an earlier one"))
    return rows.join(bad, pair).select(pair, "ordinal", "status", "before_id", "after_id", error.alias("error"))


def compatible(kind_a: Column, kind_b: Column) -> Column:
    """Whether two files can be compared: both drawings, or both pages."""
    return F.coalesce((F.lower(kind_a) == F.lower(kind_b)) & F.lower(kind_a).isin("cad", "pdf"), F.lit(False))


def matched_pages(scores: DataFrame, a: DataFrame, b: DataFrame, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """The one-to-one assignment of pages of most total score, with its status, and what is left of either side.

    ``scores`` has ``a_id b_id score``, the sides have ``id``. Assigned pairs below ``review`` are
    left unmatched; a drawing's pages and another format's are paired alike.
    """
    pairs = optimal(scores.select("a_id", "b_id", (1 - F.col("score")).alias("cost")), "cost").withColumn("score", 1 - F.col("cost")).filter(F.col("score") >= review)
    found = pairs.select("a_id", "b_id", "score", status(F.col("score"), auto=auto, review=review).alias("status"))
    left = unmatched(a.select("id"), "id", found, "a_id").select(F.col("id").alias("a_id"), F.lit(None).cast(b.schema["id"].dataType).alias("b_id"), F.lit(0.0).alias("score"), F.lit("UNMATCHED_A").alias("status"))
    right = unmatched(b.select("id"), "id", found, "b_id").select(F.lit(None).cast(a.schema["id"].dataType).alias("a_id"), F.col("id").alias("b_id"), F.lit(0.0).alias("score"), F.lit("UNMATCHED_B").alias("status"))
    return found.unionByName(left).unionByName(right)


def local_entities(entities: DataFrame, regions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Entities whose centre lies in a region, moved to the region's lower corner. ``regions`` has ``region match x0 y0 x1 y1``; an entity in several is in each."""
    rows = entities.join(regions.select(*on, "region", "match", F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1")), list(on))
    rows = rows.filter(F.col("x").between(F.col("rx0"), F.col("rx1")) & F.col("y").between(F.col("ry0"), F.col("ry1")))
    return rows.withColumns({"x": F.col("x") - F.col("rx0"), "y": F.col("y") - F.col("ry0")}).drop("rx1", "ry1")


def region_diff(old: DataFrame, new: DataFrame, old_regions: DataFrame, new_regions: DataFrame, on: Sequence[str], keys: Sequence[str], quantum: float) -> DataFrame:
    """Records of matched regions that only one revision has, compared from their region's own corner, in world places.

    ``keys`` name equal records beside their place, which counts at ``quantum``. Equal records pair by occurrence.
    """
    cells = [F.rint(F.col(c) / quantum).cast("long").alias(f"_{c}") for c in ("x", "y")]

    def side(entities: DataFrame, regions: DataFrame) -> DataFrame:
        rows = local_entities(entities, regions, on).select("match", "region", *keys, *cells, "id", (F.col("x") + F.col("rx0")).alias("x"), (F.col("y") + F.col("ry0")).alias("y"))
        order = F.row_number().over(Window.partitionBy("match", *keys, "_x", "_y").orderBy("id"))
        return rows.withColumn("_n", order)

    key = ["match", *keys, "_x", "_y", "_n"]
    one, two = side(old, old_regions), side(new, new_regions)
    gone = one.join(two.select(*key), key, "left_anti").withColumn("change_type", F.lit("deleted"))
    come = two.join(one.select(*key), key, "left_anti").withColumn("change_type", F.lit("added"))
    return gone.unionByName(come).select("match", "region", *keys, "id", "x", "y", "change_type")
