"""Overlay pages in their store."""

from pyspark.sql import functions as F

from driftline.sources import records


def test_files_do_not_grow_with_pages(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 2).alias("pair_id"), "id")
    records.write_pages(rows, str(tmp_path / "pages"), "pair_id", ["id"], 3)
    assert len(list((tmp_path / "pages").rglob("*.parquet"))) == 2
    assert sorted(r.id for r in records.read_page(spark, str(tmp_path / "pages"), "pair_id", 1, 7).collect()) == [43, 45, 47]
