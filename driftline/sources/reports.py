"""What a comparison leaves on disk: results, zones, omitted zones, table differences, dashboards, and caches of what was read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a zone file, and of the file of zones that a cap left out (fixed values).
ZONE = ("pair_id", "zone_id", "drawing_number", "change_type", "severity", "status", "raw_change_count", "added", "deleted", "modified", "bbox_min_x", "bbox_min_y", "bbox_max_x", "bbox_max_y", "layers", "entity_types", "reasons")
OMITTED = ("pair_id", "zone_id", "drawing_number", "severity", "raw_change_count", "bbox", "omitted_reason")


def write_result(summary: DataFrame, items: DataFrame, path: str) -> None:
    """A run's summary and items as JSON lines."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    items.write.mode("overwrite").json(f"{path}/items")


def zone_rows(zones: DataFrame) -> DataFrame:
    """Zones (``x0 y0 x1 y1``, arrays ``layers entity_types reasons``) as rows of a zone file; columns that they lack are empty."""
    box = {f"bbox_{m}_{a}": F.round(F.col(f"{a}{i}"), 3) for a in "xy" for m, i in (("min", 0), ("max", 1))}
    joined = {n: F.array_join(n, " | ") for n in ("layers", "entity_types", "reasons") if n in zones.columns}
    have = {n: F.col(n) for n in zones.columns} | box | joined
    return zones.select(*[have.get(n, F.lit("")).alias(n) for n in ZONE])


def write_zones(zones: DataFrame, path: str) -> None:
    """Zones as CSV and as JSON."""
    zone_rows(zones).write.mode("overwrite").option("header", "true").csv(f"{path}/change_zones_csv")
    zones.write.mode("overwrite").json(f"{path}/change_zones_json")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Rows of zone files, all as text, as they were written."""
    return spark.read.option("header", "true").option("nullValue", "").csv(f"{path}/change_zones_csv")


def write_omitted(zones: DataFrame, path: str, reason: str = "reason") -> None:
    """Zones that a cap left out, with why; zones without a reason are none of them."""
    text = F.concat_ws(", ", *[F.format_number(F.col(c), 3) for c in ("x0", "y0", "x1", "y1")])
    rows = zones.filter(F.col(reason).isNotNull()).withColumns({"bbox": text, "omitted_reason": F.col(reason)})
    rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in OMITTED]).write.mode("overwrite").option("header", "true").csv(f"{path}/omitted_zones")


def write_table_report(diff: DataFrame, summary: DataFrame, path: str, kind: str = "json") -> None:
    """A table comparison's rows and summary, as JSON or as CSV for a spreadsheet."""
    for name, df in (("changes", diff), ("summary", summary)):
        writer = df.write.mode("overwrite")
        writer.json(f"{path}/{name}") if kind == "json" else writer.option("header", "true").csv(f"{path}/{name}")


def write_dashboard(issues: DataFrame, drawings: DataFrame, patterns: DataFrame, path: str, top: int = 100) -> None:
    """A review dashboard: the first issues by priority (its feature is a short list), all drawings, all patterns."""
    issues.orderBy(F.desc("priority_score"), "zone_id").limit(top).write.mode("overwrite").option("header", "true").csv(f"{path}/review_priority")
    drawings.write.mode("overwrite").json(f"{path}/drawings")
    patterns.write.mode("overwrite").option("header", "true").csv(f"{path}/layer_pattern_summary")


def write_artifacts(zones: DataFrame, path: str, reason: str = "reason") -> DataFrame:
    """All files of a batch, and a row for each of its pairs: zones, those left out, changes."""
    write_zones(zones, path)
    write_omitted(zones, path, reason)
    manifest = zones.groupBy("pair_id").agg(F.count("*").alias("zone_count"), F.count(reason).alias("omitted_count"), F.sum("raw_change_count").alias("raw_change_count"))
    manifest.write.mode("overwrite").json(f"{path}/artifact_manifest")
    return zones.sparkSession.read.schema(manifest.schema).json(f"{path}/artifact_manifest")


def cloud_marks(zones: DataFrame, chord: float) -> DataFrame:
    """Revision clouds as polylines: each zone's outline, cut into equal arcs with a bulge outward (``pair_id zone_id x0 y0 x1 y1``)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.lit(8), F.ceil(2 * (w + h) / chord).cast("int"))
    length = 2 * (w + h)

    def corner(i: Column) -> Column:
        d = length * i / n
        x = F.when(d <= w, F.col("x0") + d).when(d <= w + h, F.col("x1")).when(d <= 2 * w + h, F.col("x1") - (d - w - h)).otherwise(F.col("x0"))
        y = F.when(d <= w, F.col("y0")).when(d <= w + h, F.col("y0") + (d - w)).when(d <= 2 * w + h, F.col("y1")).otherwise(F.col("y1") - (d - 2 * w - h))
        return F.struct(x.alias("x"), y.alias("y"), F.lit(-0.5).alias("bulge"))

    return zones.select("pair_id", "zone_id", F.transform(F.sequence(F.lit(0), n - 1), corner).alias("vertices"), F.lit(True).alias("closed"))


def signature(columns: Sequence[str], options: str) -> Column:
    """What a cached descriptor is known by: a file's columns (path, size, time) and the options it was made with."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(options)), 256)


def cached(files: DataFrame, cache: DataFrame, options: str, columns: Sequence[str] = ("path", "length", "modificationTime")) -> tuple[DataFrame, DataFrame]:
    """(descriptors that the cache has of these files, files that must be read). ``cache`` has ``signature``."""
    rows = files.withColumn("signature", signature(columns, options))
    return rows.join(cache, "signature"), rows.join(cache.select("signature"), "signature", "left_anti")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _cells(content: bytes) -> Iterator[tuple[str, int, str, str | None]]:
    """(sheet, row, column, value as text) of a workbook, one row at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            with z.open(name) as f:
                for _, cell in ElementTree.iterparse(f):
                    if not cell.tag.endswith("}c"):
                        continue
                    at = re.match(r"([A-Z]+)([0-9]+)", cell.get("r", ""))
                    value = cell.find("m:v", _NS)
                    inline = cell.find("m:is", _NS)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else value.text if value is not None else None
                    if at and text is not None:
                        yield name.rsplit("/", 1)[1][:-4], int(at[2]), at[1], shared[int(text)] if cell.get("t") == "s" else text
                    cell.clear()


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of every workbook below a folder: ``path sheet row column value``; a broken file is one row with an ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet", "row", "column", "value", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *cell, None) for cell in _cells(content)]
                except Exception as e:  # a broken file is a row, not a failed job
                    rows = [(path, None, 0, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(parse, "path string, sheet string, row long, column string, value string, error string")
