"""Tables and the two revisions that the queries compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new revision of orders: rows gone, rows come, some prices and priorities changed."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    new = orders.filter(key % 97 != 0).withColumns(
        {
            "o_totalprice": F.when(key % 13 == 0, F.col("o_totalprice") + 10).when(key % 17 == 0, F.col("o_totalprice") + 0.0005).otherwise(F.col("o_totalprice")),
            "o_orderpriority": F.when(key % 19 == 0, F.lit("9-CHANGED")).otherwise(F.col("o_orderpriority")),
        }
    )
    return orders.filter(key % 89 != 0), new


#: The same revisions for SQL.
ORDER_REVISIONS = """
old_rev AS (SELECT * FROM orders WHERE o_orderkey % 89 <> 0),
new_rev AS (
  SELECT * REPLACE (
    CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 10 WHEN o_orderkey % 17 = 0 THEN o_totalprice + 0.0005 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 19 = 0 THEN '9-CHANGED' ELSE o_orderpriority END AS o_orderpriority)
  FROM orders WHERE o_orderkey % 97 <> 0)
"""
