"""Rows in one place are walked as classes: the same result as the walk over all edges, without making these."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import assign, expand, regions, spatial, zones
from driftline.plans.scratch import Scratch
from driftline.queries import QUERIES
from driftline.queries import spatial as queries_of_parts
from tests.test_walks import walk


def points(seed, n, first):
    """Points on a small grid, so that many share a place and many distances are equal."""
    r = random.Random(seed)
    return [(first + i, r.randrange(6) * 0.5, r.randrange(6) * 0.5) for i in r.sample(range(5 * n), n)]


def near(a, b, radius):
    edges = [(x[0], y[0], ((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2) ** 0.5) for x in a for y in b]
    return [e for e in edges if e[2] <= radius]


@pytest.mark.parametrize(("order", "most"), [(["distance", "a_id", "b_id"], 40), (["a_id", "distance", "b_id"], 200_000)])
def test_walk_of_classes_equals_the_walk_of_edges(spark, monkeypatch, order, most):
    """In one piece, and with places in the order and components too large for a task."""
    monkeypatch.setattr(assign, "MOST_WALKED", most)
    monkeypatch.setattr(assign, "DENSE", 1)
    a, b = points(1, 300, 0), points(2, 200, 100)
    one, two = (spark.createDataFrame(side, "id long, x double, y double") for side in (a, b))
    edges, ma, mb = spatial.near_places(one, two, 1.0, 1.0)
    got = {(r.a_id, r.b_id) for r in assign.greedy_classes(edges, ma, mb, order).collect()}
    at = {"a_id": 0, "b_id": 1, "distance": 2}
    assert got == {e[:2] for e in walk(near(a, b, 1.0), lambda e: tuple(e[at[c]] for c in order))} and len(got) > 100


def test_copies_make_no_edges(spark, monkeypatch, tmp_path):
    """a thousand parts in one place are not a million edges."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(1).drop("p_partkey")
    part.crossJoin(spark.range(1, 1001).withColumnRenamed("id", "p_partkey")).withColumns({"p_retailprice": part.p_retailprice * 0 + 900}).write.parquet(str(tmp_path / "part.parquet"))
    rows, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (out := write(self, df, name), rows.append(out.count()))[0])
    assert QUERIES["greedy_pairs"](spark, str(tmp_path)).count() == 989 and max(rows) <= 4000


@pytest.fixture
def rows_written(monkeypatch):
    """The number of rows of each table that is written to the shared folder."""
    rows, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (out := write(self, df, name), rows.append(out.count()))[0])
    return rows


def boxes(spark, first):
    """Three hundred boxes with ids from ``first``, of three shapes."""
    return spark.range(first, first + 300).selectExpr("id", "'s' AS sheet", "named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', 4.0D + id % 3, 'y1', 4.0D) AS box")


def test_truth_of_one_place(spark, rows_written):
    """F9."""
    rows = spark.range(300).selectExpr("id", "1.0D AS x", "2.0D AS y", "'k' AS kind")
    got = regions.truth_pairs(rows, rows.filter("id >= 100"), 1.0, ["kind"]).collect()
    assert {(r.truth_id, r.predicted_id) for r in got} == {(i, i - 100) for i in range(100, 300)} and max(rows_written) <= 600


def test_blocks_of_one_shape(spark, rows_written):
    """an old block takes the free new block of its own shape first."""
    got = regions.block_pairs(boxes(spark, 0), boxes(spark, 300), ["sheet"], 8.0).collect()
    assert {(r.a_id, r.b_id) for r in got} == {(i, 300 + i) for i in range(300)} and max(rows_written) <= 1200


def test_suppression_of_one_shape(spark, rows_written):
    """the first of the largest stays."""
    assert [r.id for r in regions.suppressed(boxes(spark, 0), ["sheet"], 8.0, 0.3).collect()] == [2] and max(rows_written) <= 300


def test_clusters_of_one_shape(spark, rows_written):
    """equal boxes are joined once; boxes with a null are alone."""
    rows = boxes(spark, 0).unionByName(boxes(spark, 300).selectExpr("id", "sheet", "named_struct('x0', CAST(NULL AS DOUBLE), 'y0', 0.0D, 'x1', 4.0D, 'y1', 4.0D) AS box"))
    got = {r.id: r.zone for r in zones.clusters(rows, 1.0, 4.0, ["sheet"]).collect()}
    assert got == {i: 0 if i < 300 else i for i in range(600)} and max(rows_written) <= 600


def test_relocations_of_one_place(spark, rows_written):
    """F7."""
    rows = spark.range(600).selectExpr("id", "id % 2 * 50.0D AS x", "0.0D AS y", "10.0D AS width", "IF(id = 0, 9.0D, 1.0D) AS height", "id % 2 AS n_added", "1 - id % 2 AS n_deleted", "IF(id % 2 = 0, 'deleted', 'added') AS change_type")
    got = zones.relocations(rows).collect()
    assert {(r.a_id, r.b_id) for r in got} == {(i, i + 1) for i in range(0, 600, 2)} and max(rows_written) <= 1200


def test_many_with_many_is_spread(spark):
    """F15, F16: the rows of few keys are in several tasks."""
    few, many = spark.range(20).selectExpr("id % 2 AS k", "id AS f"), spark.range(300).selectExpr("id % 2 AS k", "id AS m")
    got = expand.many_with_many(few, many, "k", "m")
    assert {(r.f, r.m) for r in got.collect()} == {(f, m) for f in range(20) for m in range(300) if f % 2 == m % 2} and got.count() == 3000
    assert got.groupBy(F.spark_partition_id()).count().count() > 2


def test_hungarian_pairs_solves_components_of_many_copies(spark, tmp_path):
    """A component of over 200 nodes a side is solved whole: most pairs, then least distance."""
    r = random.Random(4)
    rows = [(i, "K", r.randrange(14) * 0.5, r.randrange(1, 4)) for i in range(1, 261)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    near = {(e.a_id, e.b_id): e.distance for e in spatial.near_points(*queries_of_parts._points(spark, str(tmp_path)), 1.0, 1.0, ["kind"]).collect()}
    a, b = (sorted({e[i] for e in near}) for i in (0, 1))
    cost = np.full((len(a), len(b)), assign.NO_EDGE)
    for (x, y), d in near.items():
        cost[a.index(x), b.index(y)] = d
    cost = cost if len(a) <= len(b) else cost.T
    best = [v for v in cost[np.arange(len(cost)), assign.hungarian(cost)] if v < assign.NO_EDGE]
    got = QUERIES["hungarian_pairs"](spark, str(tmp_path)).collect()
    assert len(a) > assign.MOST_OPTIMAL and len(got) == len(best) == len({r.a_id for r in got}) == len({r.b_id for r in got})
    assert sum(near[r.a_id, r.b_id] for r in got) == pytest.approx(sum(best))


def test_flows_equal_the_assignment_of_members():
    """Costs below zero, equal costs, and nodes that can't all be served."""
    rng = np.random.default_rng(1)
    for _ in range(100):
        supply, demand = (rng.integers(1, 4, k) for k in rng.integers(1, 5, 2))
        edges = [(i, j) for i in range(len(supply)) for j in range(len(demand)) if rng.random() < 0.6] or [(0, 0)]
        price = rng.integers(-2, 4, len(edges)) / 4
        flow = assign.transported(*np.array(edges).T, price, supply.tolist(), demand.tolist())
        one, two = np.repeat(np.arange(len(supply)), supply), np.repeat(np.arange(len(demand)), demand)
        cost = np.full((len(one), len(two)), 1e6)
        for (i, j), c in zip(edges, price, strict=True):
            cost[np.ix_(one == i, two == j)] = c
        cost = cost if len(one) <= len(two) else cost.T
        best = [v for v in cost[np.arange(len(cost)), assign.hungarian(cost)] if v < 1e6]
        assert min(flow) >= 0 and sum(flow) == len(best) and np.dot(flow, price) == pytest.approx(sum(best))
        for i, most in ((0, supply), (1, demand)):
            assert all(sum(f for f, e in zip(flow, edges, strict=True) if e[i] == k) <= n for k, n in enumerate(most))


def test_flows_of_one_large_component_look_around_their_nodes(monkeypatch):
    """F2 of the third round: serving a node does not visit all nodes of its component."""
    n, pushed = 4000, []
    for name in ("heappush", "heapify"):
        monkeypatch.setattr(assign, name, lambda heap, *item, f=getattr(assign, name): (pushed.append(len(item) or len(heap)), f(heap, *item)) and None)
    x, y = np.repeat(np.arange(n), 2), np.repeat(np.arange(n), 2) + np.tile([0, 1], n)
    price = np.random.default_rng(2).integers(1, 9, 2 * n) / 8
    flow = assign.transported(x, y, price, [1] * n, [1] * (n + 1))
    left, right = np.concatenate([[0], np.cumsum(price[::2])]), np.concatenate([np.cumsum(price[1::2][::-1])[::-1], [0]])
    assert sum(flow) == n and np.dot(flow, price) == pytest.approx((left + right).min()) and sum(pushed) < 200 * n


def test_truth_of_large_groups_is_walked_without_rounds(spark, monkeypatch):
    """F4 of the third round: groups whose edges are more than a walk of components holds are no edges of members, nor rounds."""
    monkeypatch.setattr(assign, "MOST_WALKED", 50)
    monkeypatch.setattr(assign, "_with_members", None)
    truth, predicted = points(7, 300, 0), points(8, 250, 100)
    want = {e[:2] for e in walk(near(truth, predicted, 1.0), lambda e: (e[0], e[2], e[1]))}
    a, b = (spark.createDataFrame([(*row, "k") for row in side], "id long, x double, y double, kind string") for side in (truth, predicted))
    assert {(r.truth_id, r.predicted_id) for r in regions.truth_pairs(b, a, 1.0, ["kind"]).collect()} == want and len(want) > 100


def test_relocation_pairs_of_one_size_are_spread(spark, monkeypatch):
    """Zones of one size and count, and one that is alone, in a small table: all pairs, by several tasks."""
    row = ["0.0D AS x", "0.0D AS y", "IF(id = 0, 90.0D, 10.0D) AS width", "IF(id = 0, 9.0D, 1.0D) AS height", "id % 2 AS n_added", "1 - id % 2 AS n_deleted", "IF(id % 2 = 1, 'added', 'deleted') AS change_type"]
    monkeypatch.setattr(zones, "PART_ROWS", 50, raising=False)
    got = zones.relocation_candidates(spark.range(0, 4000, 1, 1).selectExpr("id", *row)).select("a_id", "b_id", F.spark_partition_id().alias("task"))
    n, a, b, tasks = got.agg(F.count_distinct("a_id", "b_id"), F.count_distinct("a_id"), F.count_distinct("b_id"), F.count_distinct("task")).first()
    assert (n, a, b) == (1999 * 2000, 1999, 2000) and got.count() == n
    assert tasks > 4


def test_relocations_of_one_size_make_few_pairs(spark, rows_written, monkeypatch):
    """F1 of the third round: zones of one size and some of others, in many places, are linked as a walk over all pairs does, without making these."""
    monkeypatch.setattr(zones, "FEW_PAIRS", 500, raising=False)
    monkeypatch.setattr(zones, "PROBES", 16, raising=False)
    r = random.Random(5)
    size = lambda i: (10.0, 1.0) if i % 7 else (10.0 + r.randrange(9) * 0.5, 1.0 + r.randrange(3))
    rows = [(i, float(r.randrange(3000)), float(r.randrange(1, 9)), *size(i), i % 2, 1 - i % 2, "added" if i % 2 else "deleted") for i in range(900)]
    table = spark.createDataFrame(rows, "id long, x double, y double, width double, height double, n_added long, n_deleted long, change_type string")
    edges = [(a[0], b[0], abs(a[3] - b[3]) + abs(a[4] - b[4]), ((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2) ** 0.5) for a in rows[::2] for b in rows[1::2] if abs(a[3] - b[3]) <= 2 and abs(a[4] - b[4]) <= 2]
    want = {e[:2] for e in walk(edges, lambda e: (e[2], e[3], e[0], e[1]))}
    assert {(r.a_id, r.b_id) for r in zones.relocations(table).collect()} == want and len(edges) > 150_000
    assert max(rows_written) <= 20_000
    odd = table.withColumn("x", F.when(F.col("id") == 1, None).otherwise(F.col("x")))
    assert zones.relocations(odd).count() == len(want)


def test_relocations_of_one_place_and_size(spark, rows_written):
    """F7, with zones of one size."""
    rows = spark.range(600).selectExpr("id", "id % 2 * 50.0D AS x", "0.0D AS y", "10.0D AS width", "1.0D AS height", "id % 2 AS n_added", "1 - id % 2 AS n_deleted", "IF(id % 2 = 0, 'deleted', 'added') AS change_type")
    assert {(r.a_id, r.b_id) for r in zones.relocations(rows).collect()} == {(i, i + 1) for i in range(0, 600, 2)} and max(rows_written) <= 1200
