"""Block expansion, style resolution, normalisation filters over entity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geometry import steps
from driftline.plans.scratch import Scratch


#: Parts that each key of a join of many with many is dealt into.
PARTS = 32


def many_with_many(few: DataFrame, many: DataFrame, on: str, part: str) -> DataFrame:
    """An equi-join whose keys have many rows on both sides, spread over tasks: ``many`` in parts by its column ``part``, ``few`` copied to each.

    Such sides are small files and their join is not, so the tasks are neither broadcast nor merged.
    """
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(n, on, "_part")
    two = many.withColumn("_part", F.pmod(F.xxhash64(part), F.lit(PARTS)).cast("int")).repartition(n, on, "_part")
    return two.join(one.hint("merge"), [on, "_part"]).drop("_part")


def expand_once(inserts: DataFrame, children: DataFrame) -> DataFrame:
    """Children of each insert's block, moved, scaled and turned into place; children on layer ``0`` take the insert's layer.

    ``inserts`` has ``insert_id block x y sx sy angle layer``, ``children`` has ``block child_id cx cy radius layer``.
    """
    c = F.col
    kids = children.withColumnRenamed("layer", "child_layer")
    turn = F.radians(c("angle"))
    rows = many_with_many(kids, inserts.withColumns({"_cos": F.cos(turn), "_sin": F.sin(turn)}), "block", "insert_id")
    px, py = c("cx") * c("sx"), c("cy") * c("sy")
    return rows.select(
        "insert_id", "child_id", "block", (px * c("_cos") - py * c("_sin") + c("x")).alias("x"), (px * c("_sin") + py * c("_cos") + c("y")).alias("y"),
        (c("radius") * (F.abs(c("sx")) + F.abs(c("sy"))) / 2).alias("radius"), F.when(c("child_layer") == "0", c("layer")).otherwise(c("child_layer")).alias("layer"),
    )


def expand_nested(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """All descendants of the roots down to ``depth``, with the offsets along the way added up.

    ``edges`` has ``parent child dx dy``, ``roots`` has ``root``. One join a level, ended
    when a level has none; the levels are written, so none is computed twice. A cycle
    ends at ``depth``.
    """
    scratch = Scratch(edges.sparkSession, "expand")
    level = roots.select("root", F.col("root").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("level"))
    out = level
    for n in range(1, depth + 1):
        down = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), F.lit(n).alias("level"))
        level = scratch.write(down, f"level-{n}")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def resolved_style(entities: DataFrame, layers: DataFrame, attribute: str) -> DataFrame:
    """An entity's attribute and where it comes from: its own, its parent insert's (BYBLOCK), or its layer's (BYLAYER).

    ``entities`` has ``id layer parent`` and the attribute; ``layers`` has ``layer`` and the attribute.
    """
    own, parent = F.col(f"e.{attribute}"), F.col(f"p.{attribute}")
    e = entities.alias("e").join(entities.select(F.col("id").alias("parent"), attribute, F.col("layer").alias("parent_layer")).alias("p"), "parent", "left")
    e = e.join(layers.select("layer", F.col(attribute).alias("_layer")), "layer", "left").join(layers.select(F.col("layer").alias("parent_layer"), F.col(attribute).alias("_above")), "parent_layer", "left")
    above = F.when(parent == "BYLAYER", F.col("_above")).otherwise(parent)
    value = F.when(own == "BYLAYER", F.col("_layer")).when(own == "BYBLOCK", above).otherwise(own)
    source = F.when(own == "BYLAYER", "layer").when((own == "BYBLOCK") & parent.isNotNull(), "block").when(own == "BYBLOCK", "none").otherwise("entity")
    return e.select("id", value.alias(attribute), source.alias("source"))


def near_zero(kind: Column, size: Column, least: float = 1e-6) -> Column:
    """Whether an entity has no extent: text, inserts and points never count."""
    return kind.isin("LINE", "CIRCLE", "ARC", "LWPOLYLINE", "HATCH") & (F.coalesce(size, F.lit(0.0)) <= least)


def normalisation_report(before: DataFrame, x: str, y: str, quantum: float, dropped: Column) -> DataFrame:
    """Rows in, out, removed as empty, and rows whose coordinates rounding changes."""
    changed = (F.abs(F.col(x) - steps(F.col(x), quantum) * quantum) > 1e-9) | (F.abs(F.col(y) - steps(F.col(y), quantum) * quantum) > 1e-9)
    return before.agg(F.count("*").alias("n_in"), F.count_if(~dropped).alias("n_out"), F.count_if(dropped).alias("n_removed"), F.count_if(changed & ~dropped).alias("n_rounded"))


def shape_hash(columns: Sequence[Column]) -> Column:
    """One hash of quantised geometry: equal shapes have equal hashes."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]), 256)


def line_key(x0: Column, y0: Column, x1: Column, y1: Column, quantum: float) -> Column:
    """A line whichever way it was drawn."""
    a = F.struct(steps(x0, quantum).alias("x"), steps(y0, quantum).alias("y"))
    b = F.struct(steps(x1, quantum).alias("x"), steps(y1, quantum).alias("y"))
    low, high = F.least(a, b), F.greatest(a, b)
    return F.concat_ws(",", *[v.cast("string") for v in (low["x"], low["y"], high["x"], high["y"])])


def block_fingerprint(members: DataFrame, block: str, text: str) -> DataFrame:
    """A digest of the texts in each block, in whatever order they come."""
    return members.groupBy(block).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce(text, F.lit("")))), "\x1f"), 256).alias("fingerprint"), F.count("*").alias("n_texts"))


def descriptors(entities: DataFrame, key: str) -> DataFrame:
    """Features of each drawing: counts of its kinds as a map, its layers, its box. ``entities`` has ``kind layer x y``."""
    counts = entities.groupBy(key, "kind").agg(F.count("*").alias("n"))
    kinds = counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    rest = entities.groupBy(key).agg(F.array_sort(F.collect_set("layer")).alias("layers"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n_entities"))
    return rest.join(kinds, key)
