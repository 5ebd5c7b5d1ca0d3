"""Keyed and multiset differences of two revisions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.cells import cells_equal, numbers_equal

NUMERIC_TOLERANCE = 0.001
#: Names that mark a key column, tried from the left (fixed values).
KEY_WORDS = ("id", "번호", "no", "key", "code", "부재", "요소")


def detect_key(old: DataFrame, new: DataFrame) -> str | None:
    """The first common column, from the left, whose name holds a key word; else the first common column."""
    common = [c for c in old.columns if c in set(new.columns)]
    return next((c for c in common if any(w in c.lower() for w in KEY_WORDS)), common[0] if common else None)


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the first by ``order``. Duplicates of a key beyond it do not take part."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def joined(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join of both revisions: ``keys``, struct ``o``, struct ``n`` (null where the key is absent)."""
    a = old.select(*keys, F.struct(*columns).alias("o"))
    b = new.select(*keys, F.struct(*columns).alias("n"))
    return a.join(b, list(keys), "full_outer")


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = NUMERIC_TOLERANCE) -> DataFrame:
    """One row per added key, deleted key and changed cell.

    Keys are taken to be unique on either side (``first_of_key`` makes them so). One shuffle
    join on the keys; the cells of a row are compared in place and only those that differ
    are exploded.
    """
    types = {f.name: f.dataType for f in old.schema.fields}

    def differs(c: str):
        same = numbers_equal if isinstance(types[c], T.NumericType) else cells_equal
        return ~same(F.col(f"o.{c}"), F.col(f"n.{c}"), tolerance)

    def cell(kind: str, name: str | None, a, b):
        return F.struct(F.lit(kind).alias("change_type"), F.lit(name).cast("string").alias("column_name"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"))

    none = F.lit(None)
    cells = F.filter(F.array(*[F.when(differs(c), cell("MODIFIED", c, F.col(f"o.{c}"), F.col(f"n.{c}"))) for c in columns]), lambda x: x.isNotNull())
    changes = F.when(F.col("o").isNull(), F.array(cell("ADDED", None, none, none))).when(F.col("n").isNull(), F.array(cell("DELETED", None, none, none))).otherwise(cells)
    return joined(old, new, keys, columns).select(*keys, F.inline(changes))


def diff_summary(changes: DataFrame) -> DataFrame:
    """Counts by column and kind, by kind, and in all (``column_name`` and ``change_type`` null where summed over)."""
    return (
        changes.select(F.coalesce("column_name", F.lit("<row>")).alias("column_name"), "change_type")
        .groupingSets([["column_name", "change_type"], ["change_type"], []], "column_name", "change_type")
        .agg(F.count("*").alias("n_changes"))
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "occurrence") -> DataFrame:
    """Occurrence number of each row among the rows of its key, so that equal rows pair one to one."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def multiset_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Pairs min(n, m) rows of each key in order of their ids; the rest are deleted or added.

    One exchange a side: the window and the join hash on the same keys.
    """
    a = numbered(old.select(*keys, F.col(id_col).alias("old_id")), keys, ["old_id"])
    b = numbered(new.select(*keys, F.col(id_col).alias("new_id")), keys, ["new_id"])
    kind = F.when(F.col("new_id").isNull(), "DELETED").when(F.col("old_id").isNull(), "ADDED").otherwise("UNCHANGED")
    return a.join(b, [*keys, "occurrence"], "full_outer").withColumn("change_type", kind)


def multiset_counts(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired, deleted and added rows of each key without numbering rows: counts alone, combined before the shuffle."""
    both = old.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = both.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return n.select(*keys, F.least("a", "b").alias("n_paired"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n_deleted"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("n_added"))


def moved_between_groups(old: DataFrame, new: DataFrame, shape: Sequence[str], group_col: str, id_col: str) -> DataFrame:
    """Rows left over on both sides with the same shape in another group: a move, paired in order of ids."""
    rest = multiset_diff(old, new, [*shape, group_col], id_col)
    gone = numbered(rest.filter("change_type = 'DELETED'").select(*shape, F.col(group_col).alias("old_group"), "old_id"), shape, ["old_id"])
    come = numbered(rest.filter("change_type = 'ADDED'").select(*shape, F.col(group_col).alias("new_group"), "new_id"), shape, ["new_id"])
    return gone.join(come, [*shape, "occurrence"]).filter("old_group <> new_group").drop("occurrence")
