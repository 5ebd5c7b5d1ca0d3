"""Spatial joins at size: what is copied over cells is not broadcast, however small its files are."""

import pytest

from driftline.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["grid_near_match", "square_tolerance_match", "bbox_overlap_iou"])
def test_copies_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def text_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_mutual_best_moves_one_edge_a_node(spark):
    assert "Window" not in text_of(spark, "mutual_best_pairs")


def test_rivals_combine_before_the_shuffle(spark):
    assert "partial_count" in text_of(spark, "competing_margins")


def test_margins_equal_the_join_of_all_edges(spark):
    """Equal scores, lone edges and several edges at a node."""
    from driftline.operators import assign

    rows = [(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.2), (2, 1, 0.9), (3, 4, 0.7), (4, 3, -0.5)]
    got = {(r.a_id, r.b_id): r.competing for r in assign.competing(spark.createDataFrame(rows, "a_id long, b_id long, score double")).collect()}
    assert got == {(a, b): max([t for x, y, t in rows if ((x == a) != (y == b))] or [0.0]) if (a, b) != (4, 3) else 0.2 for a, b, _ in rows} | {(3, 4): 0.0}


def test_nearby_looks_no_further_than_it_must(spark, monkeypatch):
    """A hundred entities in one place: three neighbours of each are found without the pairs of the whole radius."""
    from driftline.operators import regions, spatial

    radii, near = [], spatial.near_points
    monkeypatch.setattr(spatial, "near_points", lambda a, b, radius, *rest: radii.append(radius) or near(a, b, radius, *rest))
    rows = spark.range(100).selectExpr("id", "1.0D AS x", "0.0D AS y")
    got = regions.nearby(rows, rows, 2.0, 3, []).collect()
    assert radii == [0.25] and len(got) == 300 and all(r.a_id != r.b_id for r in got)


def test_plain_match_joins_on_cells(spark):
    assert "gx" in text_of(spark, "near_match_plain")


def test_nearest_broadcasts_no_points(spark, monkeypatch):
    """Which points have their k is as many rows as there are points, however small its file."""
    from driftline.operators import spatial

    plans, write = [], spatial.Scratch.write
    monkeypatch.setattr(spatial.Scratch, "write", lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, name))[1])
    rows = spark.range(60).selectExpr("id", "CAST(id * id AS DOUBLE) AS x", "0.0D AS y")
    got = spatial.nearest(rows, rows, 2, 1.0)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == 120 and len(plans) > 3 and all("BroadcastHashJoin" not in p for p in plans)
