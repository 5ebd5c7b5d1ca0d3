"""Change streams, telemetry, decisions and result sets on disk: schemas, readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

VERSION = 1
CHANGE = "schema_version int, pair_id string, change_type string, entity_type string, layer string, x0 double, y0 double, x1 double, y1 double"
PERF = "ts timestamp, run_id string, stage string, event string, elapsed_ms double, cache_hit boolean, cache_key_hash string, rss_mb double, error_code string"
MANUAL = "a_path string, b_path string, status string, note string"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Changes of a line-delimited stream; a malformed line or a foreign version fails, a change without a box is left out."""
    rows = spark.read.schema(CHANGE).option("mode", "FAILFAST").json(path)
    checked = rows.withColumn("schema_version", F.when(F.col("schema_version") == VERSION, F.col("schema_version")).otherwise(F.raise_error(F.lit("change record of another schema version")).cast("int")))
    return checked.filter("schema_version IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")


def write_changes(changes: DataFrame, path: str) -> int:
    """Write a stream (committed as a whole) and return how many changes had no box."""
    seen = Observation()
    missing = F.expr("x0 IS NULL OR y0 IS NULL OR x1 IS NULL OR y1 IS NULL")
    rows = changes.withColumn("schema_version", F.lit(VERSION)).select(*[f.split()[0] for f in CHANGE.split(", ")]).observe(seen, F.count_if(missing).alias("missing"))
    rows.write.mode("overwrite").json(path)
    return int(seen.get["missing"])


def read_perf(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines; malformed ones are skipped."""
    return spark.read.schema(PERF).option("mode", "DROPMALFORMED").json(path)


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """Manual pairing decisions, statuses lower-cased."""
    return spark.read.schema(MANUAL).option("header", "true").csv(path).withColumn("status", F.lower(F.trim("status")))


def write_state(df: DataFrame, path: str, key: str = "pair_id") -> None:
    """Result state, one folder for each pair, so that one pair reads alone."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A report's tables, a folder of CSV each."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def write_pages(df: DataFrame, path: str, by: str, order: list[str], size: int) -> None:
    """Overlay rows in fixed-size pages: a folder for each group, its rows in the order of their pages.

    A folder for each page would be a file for every few rows; within a group's files the
    bounds of their row groups and pages lead to a page.
    """
    from driftline.operators.ranking import pages

    pages(df, by, order, size).repartition(F.col(by)).sortWithinPartitions(by, "page", *order).write.mode("overwrite").partitionBy(by).parquet(path)


def read_page(spark: SparkSession, path: str, by: str, value, page: int) -> DataFrame:
    """One page; the group's folder and the bounds of ``page`` in its files prune the scan."""
    return spark.read.parquet(path).filter((F.col(by) == value) & (F.col("page") == page))


def listing(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Files below a folder by extension, with the kind each is dispatched to."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin("dxf", "dwg"), "cad").when(suffix == "pdf", "pdf").when(suffix.isin("xlsx", "xls", "csv"), "table").otherwise("unsupported")
    return files.withColumn("kind", kind)


def provenance(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A digest of each row as canonical JSON (columns by name, nulls left out)."""
    columns = sorted(c for c in df.columns if c not in exclude)
    return df.withColumn("provenance", F.sha2(F.to_json(F.struct(*columns)), 256))


def new_pairs(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Pairs whose content hashes no earlier result has."""
    return pairs.join(cache.select("hash_a", "hash_b"), ["hash_a", "hash_b"], "left_anti")


def manifest(stages: list[dict]) -> str:
    """A run's stages as JSON, keys sorted."""
    return json.dumps({"schema_version": VERSION, "stages": stages}, sort_keys=True, ensure_ascii=False)


#: One drawing of the adapter's JSON: the record outputs of readers that are not part of this engine.
ADAPTER = "drawing string, units string, layers array<struct<id:string,name:string,color:string,linetype:string>>, entities array<struct<id:string,type:string,layer_id:string,x:double,y:double,text:string>>"


def read_adapter(spark: SparkSession, path: str) -> DataFrame:
    """Entities of drawings that another reader wrote as JSON (one document a file), with their layers' names."""
    docs = spark.read.schema(ADAPTER).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rows = docs.select("drawing", "units", F.explode_outer("entities").alias("e"), "layers")
    layer = F.get(F.filter("layers", lambda x: x["id"] == F.col("e.layer_id")), 0)
    return rows.select("drawing", "units", "e.*", layer["name"].alias("layer_name"))


def audit_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files below a folder that still hold an absolute path."""
    from driftline.functions.text import leaks_path

    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_name").alias("file"), "value")
    return lines.filter(leaks_path(F.col("value")))
