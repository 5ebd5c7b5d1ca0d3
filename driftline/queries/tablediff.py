"""Keyed and multiset differences over orders, lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import tablediff as td
from driftline.queries.common import ORDER_REVISIONS, order_revisions, table

COLUMNS = ("o_totalprice", "o_orderpriority", "o_orderstatus")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = order_revisions(spark, sf_dir)
    return td.keyed_diff(old, new, ["o_orderkey"], COLUMNS)


def keyed_diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.when(F.col("column_name") == "o_totalprice", F.round(F.col(c).cast("double") * 100).cast("long").cast("string")).otherwise(F.col(c))
    return _changes(spark, sf_dir).select("o_orderkey", "change_type", "column_name", cents("old_value").alias("old_value"), cents("new_value").alias("new_value"))


def keyed_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.diff_summary(_changes(spark, sf_dir))


_CHANGES = f"""
WITH {ORDER_REVISIONS},
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey AS ok, n.o_orderkey AS nk,
        o.o_totalprice AS op, n.o_totalprice AS np, o.o_orderpriority AS oo, n.o_orderpriority AS no, o.o_orderstatus AS os, n.o_orderstatus AS ns
      FROM old_rev o FULL JOIN new_rev n ON o.o_orderkey = n.o_orderkey),
changes AS (
  SELECT o_orderkey, CASE WHEN ok IS NULL THEN 'ADDED' ELSE 'DELETED' END AS change_type, NULL::VARCHAR AS column_name, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value
  FROM j WHERE ok IS NULL OR nk IS NULL
  UNION ALL SELECT o_orderkey, 'MODIFIED', 'o_totalprice', CAST(CAST(round(op * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(np * 100) AS BIGINT) AS VARCHAR)
  FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND abs(op - np) > 0.001
  UNION ALL SELECT o_orderkey, 'MODIFIED', 'o_orderpriority', oo, no
  FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND replace(replace(oo, ',', ''), ' ', '') <> replace(replace(no, ',', ''), ' ', '')
  UNION ALL SELECT o_orderkey, 'MODIFIED', 'o_orderstatus', os, ns FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND os <> ns)
"""


def multiset_diff_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, keys = _line_revisions(spark, sf_dir)
    return td.multiset_diff(old, new, keys, "id").select(*keys, "occurrence", "old_id", "new_id", "change_type")


def multiset_counts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, keys = _line_revisions(spark, sf_dir)
    return td.multiset_counts(old, new, keys)


def _line_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("long").alias("qty"), "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    )
    lines = lines.groupBy("id").agg(F.min(F.struct("qty", "l_returnflag", "l_linestatus")).alias("s")).select("id", "s.*")
    old = lines.filter("id % 11 <> 0")
    new = lines.filter("id % 7 <> 0").withColumn("qty", F.when(F.col("id") % 5 == 0, F.col("qty") + 1).otherwise(F.col("qty")))
    return old, new, ["qty", "l_returnflag", "l_linestatus"]


_LINE_REVISIONS = """
lines AS (SELECT id, s.qty AS qty, s.l_returnflag AS l_returnflag, s.l_linestatus AS l_linestatus FROM (
  SELECT l_orderkey * 10 + l_linenumber AS id, min({'qty': CAST(l_quantity AS BIGINT), 'l_returnflag': l_returnflag, 'l_linestatus': l_linestatus}) AS s FROM lineitem GROUP BY 1)),
old_rev AS (SELECT * FROM lines WHERE id % 11 <> 0),
new_rev AS (SELECT id, CASE WHEN id % 5 = 0 THEN qty + 1 ELSE qty END AS qty, l_returnflag, l_linestatus FROM lines WHERE id % 7 <> 0)
"""


def layer_move_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"))
    new = part.withColumn("p_brand", F.when(F.col("p_partkey") % 23 == 0, F.concat("p_brand", F.lit("-moved"))).otherwise(F.col("p_brand"))).filter("p_partkey % 31 <> 0")
    return td.moved_between_groups(part, new, ["p_size", "price_cents"], "p_brand", "p_partkey")


QUERIES = {f.__name__: f for f in (keyed_diff_orders, keyed_diff_summary, multiset_diff_lineitem, multiset_counts_lineitem, layer_move_part)}

ORACLE_SQL = {
    "keyed_diff_orders": _CHANGES + "SELECT * FROM changes",
    "keyed_diff_summary": _CHANGES
    + """SELECT column_name, change_type, count(*) AS n_changes FROM (SELECT coalesce(column_name, '<row>') AS column_name, change_type FROM changes)
    GROUP BY GROUPING SETS ((column_name, change_type), (change_type), ())""",
    "multiset_diff_lineitem": f"""WITH {_LINE_REVISIONS},
    a AS (SELECT *, row_number() OVER (PARTITION BY qty, l_returnflag, l_linestatus ORDER BY id) AS occurrence FROM old_rev),
    b AS (SELECT *, row_number() OVER (PARTITION BY qty, l_returnflag, l_linestatus ORDER BY id) AS occurrence FROM new_rev)
    SELECT coalesce(a.qty, b.qty) AS qty, coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(a.l_linestatus, b.l_linestatus) AS l_linestatus,
      CAST(coalesce(a.occurrence, b.occurrence) AS INTEGER) AS occurrence, a.id AS old_id, b.id AS new_id,
      CASE WHEN b.id IS NULL THEN 'DELETED' WHEN a.id IS NULL THEN 'ADDED' ELSE 'UNCHANGED' END AS change_type
    FROM a FULL JOIN b ON a.qty = b.qty AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.occurrence = b.occurrence""",
    "multiset_counts_lineitem": f"""WITH {_LINE_REVISIONS},
    n AS (SELECT qty, l_returnflag, l_linestatus, sum(a) AS a, sum(b) AS b FROM (
      SELECT qty, l_returnflag, l_linestatus, 1 AS a, 0 AS b FROM old_rev UNION ALL SELECT qty, l_returnflag, l_linestatus, 0, 1 FROM new_rev) GROUP BY ALL)
    SELECT qty, l_returnflag, l_linestatus, CAST(least(a, b) AS BIGINT) AS n_paired, CAST(greatest(a - b, 0) AS BIGINT) AS n_deleted, CAST(greatest(b - a, 0) AS BIGINT) AS n_added FROM n""",
    "layer_move_part": """WITH p AS (SELECT p_partkey, p_brand, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents FROM part),
    n AS (SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN p_brand || '-moved' ELSE p_brand END AS p_brand, p_size, price_cents FROM p WHERE p_partkey % 31 <> 0),
    a AS (SELECT *, row_number() OVER (PARTITION BY p_size, price_cents, p_brand ORDER BY p_partkey) AS k FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY p_size, price_cents, p_brand ORDER BY p_partkey) AS k FROM n),
    gone AS (SELECT *, row_number() OVER (PARTITION BY p_size, price_cents ORDER BY p_partkey) AS g FROM a ANTI JOIN b USING (p_size, price_cents, p_brand, k)),
    come AS (SELECT *, row_number() OVER (PARTITION BY p_size, price_cents ORDER BY p_partkey) AS g FROM b ANTI JOIN a USING (p_size, price_cents, p_brand, k))
    SELECT p_size, price_cents, gone.p_brand AS old_group, gone.p_partkey AS old_id, come.p_brand AS new_group, come.p_partkey AS new_id
    FROM gone JOIN come USING (p_size, price_cents, g) WHERE gone.p_brand <> come.p_brand""",
}
