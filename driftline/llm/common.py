"""What the operators of this subpackage share: table access, scratch tables and text columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from driftline.plans.scratch import Scratch, shared_folder

__all__ = ["ROOT", "Scratch", "fresh", "prepare", "row_key", "shared_folder", "small", "table", "text_rows", "trimmed", "without"]

#: Folder that holds the package; sent to Python workers so that they can import it.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be one that only Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between Spark and Python where the session has Spark's own value: texts are long, and a
#: batch lies in memory on both sides.
BATCH_ROWS = "1000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started from, and bound their batches."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def text_rows(df: DataFrame, id_col: str, text_col: str, id_name: str = "doc_id") -> DataFrame:
    """Only the id and the text (null text: empty); other columns, whatever their names, do not come along."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias(id_name),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


#: Most bytes of a table that ``small`` broadcasts.
BROADCAST_BYTES = 64_000_000


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, to be broadcast if its rows hold few enough bytes; else its joins shuffle.

    The bytes are those of all rows as Spark holds them: fixed parts, and what strings and
    arrays take (their elements by the sizes of their types).
    """

    def size(of: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType | BinaryType):
            return F.octet_length(of) + 16
        if isinstance(kind, ArrayType):
            if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
                return F.aggregate(of, F.lit(24).cast("long"), lambda total, x: total + size(x, kind.elementType))
            return F.size(of) * 8 + 24
        if isinstance(kind, StructType):
            return sum((size(of[f.name], f.dataType) for f in kind.fields), F.lit(16)).cast("long")
        return F.lit(8)

    held = sum((F.coalesce(size(F.col(f"`{f.name}`"), f.dataType), F.lit(8)) for f in df.schema.fields), F.lit(16))
    total = df.agg(F.sum(held.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a filter knows a row by: its id, or a hash of its text where it has none."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (f"{stem}_{k}" for k in range(len(taken) + 1)) if name not in taken)


def without(df: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose ``row_key`` is not in ``gone`` (a written table of one column)."""
    key, own = fresh(df, "gone"), fresh(df, "own")
    rows = df.withColumn(own, row_key(id_col, text_col))
    return rows.join(small(gone.toDF(key)), F.col(own) == F.col(key), "left_anti").drop(own)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back to the system when its partition ends: workers live on."""

    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return outer
