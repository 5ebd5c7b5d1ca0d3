"""What the plans look like: no products of tables, filters and columns at the scan, aggregations that combine first."""

import re

import pytest

from driftline.queries import QUERIES, files

SF = "/root/testdata/sf0.001"
#: Queries with a product by design: a model, a catalogue, a list of regions or one row on the broadcast side.
PRODUCTS = {"embedding_classify", "clause_lookup", "viewport_overlays", "region_of_box"}
#: Queries that run jobs while they are built.
EAGER = {
    "greedy_pairs", "hungarian_pairs", "zone_clusters", "cell_clusters", "canonical_diff", "legacy_diff", "nested_expansion", "rigid_transform", "stream_windows", "stream_sliding", "stream_sessions", "frame_suppression", "text_block_pairs", "truth_matching", "reorigin_recovery",
    "knn_part", "relocation_links", "cluster_regions", "viewport_regions", "matched_pages", "reorigin_unchanged",
} | (set(files.QUERIES) - {"curve_geometry", "cloud_marks", "settings_and_keys", "descriptor_cache", "result_cache"})


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert name in PRODUCTS or "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(spark, "viewport_window")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(p_retailprice", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "keyed_diff_summary"))[1]
    assert set(re.findall(r"(\w+):", schema)) == {"o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"}


@pytest.mark.parametrize("name", ["zone_severity", "multiset_counts_lineitem", "perf_percentiles", "accuracy_by_source"])
def test_aggregations_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


def test_grid_joins_are_equi_joins(spark):
    for name in ("grid_near_match", "bbox_overlap_iou", "square_tolerance_match"):
        assert re.search(r"(SortMergeJoin|HashJoin) \[[^\]]*g[xy]", plan(spark, name)), name
