"""Every query of the engine over the shared tables, and the SQL each is held against.

A query module has ``QUERIES`` (name to function of session and folder) and ``ORACLE_SQL`` (name to SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.queries import files, metrics, ranking, records, regions, shapes, sheets, spatial, streams, tablediff, text, zones

_MODULES = (tablediff, spatial, zones, ranking, metrics, text, records, regions, streams, shapes, sheets, files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell-level differences between two revisions of the orders table."""
    return QUERIES["keyed_diff_orders"](spark, sf_dir)
