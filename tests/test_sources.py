"""Readers and writers, streams, and the kernels that SQL cannot check."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import geometry as g
from driftline.functions import text as t
from driftline.operators import assign, graph
from driftline.operators.tablediff import detect_key
from driftline.sources import dxf, records
from driftline.streaming import changes

DRAWING = """0
SECTION
2
HEADER
9
$INSUNITS
70
4
0
ENDSEC
0
SECTION
2
BLOCKS
0
BLOCK
2
DOOR
0
CIRCLE
8
0
10
1.5
20
2
40
0.5
0
ENDBLK
0
ENDSEC
0
SECTION
2
ENTITIES
0
LINE
8
S-BEAM
10
0
20
0
11
10
21
abc
0
LWPOLYLINE
8
L1
70
1
10
0
20
0
10
1
20
0
10
1
20
1
0
POLYLINE
8
L2
0
VERTEX
10
5
20
6
0
SEQEND
0
INSERT
2
DOOR
10
3
20
4
0
3DFACE
8
X
0
ENDSEC
0
SECTION
2
OBJECTS
0
DICTIONARY
0
ENDSEC
0
EOF
"""


def test_drawing_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.dxf").write_text(DRAWING)
    (tmp_path / "sub" / "b.dxf").write_text(dxf.write_text([{"raw_type": "LINE", "layer": "K", "x": 1.0, "y": 2.0, "x2": 3.0, "y2": 4.0}]))
    (tmp_path / "empty.dxf").write_text("\n")
    (tmp_path / "odd.dxf").write_bytes(b"\xff\xfe0\nfoo")
    rows = dxf.read(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    a = {r.raw_type: r for r in by["a.dxf"]}
    assert a["CIRCLE"].block == "DOOR" and a["CIRCLE"].radius == 0.5 and a["CIRCLE"].section == "BLOCKS"
    assert a["LINE"].layer == "S-BEAM" and a["LINE"].x2 == 10 and a["LINE"].y2 is None
    assert a["LWPOLYLINE"].closed and [(v.x, v.y) for v in a["LWPOLYLINE"].vertices] == [(0, 0), (1, 0), (1, 1)]
    assert [(v.x, v.y) for v in a["POLYLINE"].vertices] == [(5, 6)]
    assert a["INSERT"].name == "DOOR" and a["3DFACE"].status == "unsupported" and "DICTIONARY" not in a
    assert by["b.dxf"][0].x2 == 3 and by["empty.dxf"][0].status == "empty" and by["odd.dxf"][0].status == "empty"
    read = dxf.read(spark, str(tmp_path))
    assert {r.layer for r in dxf.layers(read).collect()} >= {"S-BEAM", "L1", "K"}
    assert [(r.raw_type, r.n) for r in dxf.unsupported(read).collect()] == [("3DFACE", 1)]
    assert dxf.version(b"AC1032xx") == "AC1032" and dxf.version(b"PK") == "unknown"


def test_change_records(spark, tmp_path):
    rows = [("p1", "added", "LINE", "L", 0.0, 0.0, 1.0, 1.0), ("p1", "deleted", "TEXT", "L", None, 0.0, 1.0, 1.0), ("p2", "added", "LINE", "M", 5.0, 0.0, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "pair_id string, change_type string, entity_type string, layer string, x0 double, y0 double, x1 double, y1 double")
    path = str(tmp_path / "changes")
    assert records.write_changes(df, path) == 1
    assert records.read_changes(spark, path).count() == 2
    stream = changes.drained(changes.running_counts(changes.change_stream(spark, path)), "counts")
    assert {(r.pair_id, r.change_type, r.n) for r in stream.collect()} == {("p1", "added", 1), ("p2", "added", 1)}
    seen = []
    changes.each_batch(changes.change_stream(spark, path), lambda batch, _: seen.append(batch.count()), str(tmp_path / "state")).awaitTermination()
    assert sum(seen) == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text(json.dumps({"schema_version": 9, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}) + "\n")
    with pytest.raises(Exception, match="schema version"):
        records.read_changes(spark, str(tmp_path / "bad")).collect()


def test_state_pages_and_listing(spark, tmp_path):
    df = spark.range(25).select((F.col("id") % 2).alias("pair_id"), "id")
    records.write_pages(df, str(tmp_path / "pages"), "pair_id", ["id"], 5)
    assert sorted(r.id for r in records.read_page(spark, str(tmp_path / "pages"), "pair_id", 0, 1).collect()) == [10, 12, 14, 16, 18]
    records.write_state(df, str(tmp_path / "state"))
    assert records.read_state(spark, str(tmp_path / "state")).filter("pair_id = 1").count() == 12
    records.write_sheets({"one": df}, str(tmp_path / "report"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "report" / "one")).count() == 25
    (tmp_path / "in").mkdir()
    for name in ("a.dxf", "b.pdf", "c.zip"):
        (tmp_path / "in" / name).write_text("x")
    assert {r.kind for r in records.listing(spark, str(tmp_path / "in"), ["dxf", "pdf"]).collect()} == {"cad", "pdf"}
    marked = records.provenance(spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string"))
    assert marked.select("provenance").distinct().count() == 2
    (tmp_path / "perf.json").write_text('{"stage": "a", "elapsed_ms": 3}\nnot json\n')
    assert records.read_perf(spark, str(tmp_path / "perf.json")).filter("stage IS NOT NULL").count() == 1
    (tmp_path / "m.csv").write_text("a_path,b_path,status,note\nx,y, Confirmed ,\n")
    assert records.read_manual(spark, str(tmp_path / "m.csv")).first().status == "confirmed"


def test_greedy_equals_the_walk(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(12) / 4) for _ in range(300)]
    edges = [(a, b, d) for (a, b), d in {(a, b): d for a, b, d in edges}.items()]
    got = assign.greedy(spark.createDataFrame(edges, "a_id long, b_id long, d double"), [F.col("d"), F.col("a_id"), F.col("b_id")])
    used_a, used_b, want = set(), set(), set()
    for a, b, d in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b, d))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("most", [200_000, 30])
def test_greedy_of_a_chain(spark, monkeypatch, most):
    """A chain in which each edge waits for the one before it."""
    monkeypatch.setattr(assign, "MOST_WALKED", most)
    n = 1000 if most > 1000 else 40
    edges = [(i // 2, (i + 1) // 2, float(i)) for i in range(n)] + [(5000 + i, 6000 + i, 1.0) for i in range(20)]
    rounds = []
    write = assign.Scratch.write
    monkeypatch.setattr(assign.Scratch, "write", lambda self, df, name: (rounds.append(name), write(self, df, name))[1])
    got = assign.greedy(spark.createDataFrame(edges, "a_id long, b_id long, d double"), [F.col("d"), F.col("a_id"), F.col("b_id")])
    assert {r.d for r in got.filter("a_id < 5000").collect()} == {float(i) for i in range(0, n, 2)} and got.filter("a_id >= 5000").count() == 20
    assert most < 1000 or len([x for x in rounds if x.startswith("round")]) <= 20


def test_optimal_equals_brute_force(spark):
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (3, 5), (5, 4)):
        cost = rng.integers(0, 20, (n, m)).astype(float)
        table = cost if n <= m else cost.T
        found = assign.hungarian(table)
        best = min(sum(table[i, p[i]] for i in range(table.shape[0])) for p in permutations(range(table.shape[1]), table.shape[0]))
        assert sum(table[i, j] for i, j in enumerate(found)) == best
        edges = spark.createDataFrame([(i, j, float(cost[i, j])) for i in range(n) for j in range(m)], "a_id long, b_id long, d double")
        rows = assign.optimal(edges, "d").collect()
        assert len(rows) == min(n, m) and sum(r.d for r in rows) == best


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            r, s = find(a), find(b)
            parent[max(r, s)] = min(r, s)
    want = {x: find(x) for x in parent}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Ａ́ b  c", "ab"), (None, "x")], "a string, b string")
    rows = df.select(t.composed(F.col("a")).alias("c"), t.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert rows[0].c == "Á B C" and rows[1].c is None and rows[1].r is None
    assert spark.range(1).select(t.matches_any(F.lit("A-temp.1"), ["*TEMP.?"]).alias("m")).first().m
    old = spark.createDataFrame([(1, 2)], "first int, part_no int")
    assert detect_key(old, old) == "part_no"


def test_geometry_edges(spark):
    one = spark.range(1)
    b = g.box(F.lit(None).cast("double"), F.lit(float("nan")), F.lit(2.0), F.lit(3.0))
    assert tuple(one.select(b.alias("b")).first().b) == (0, 0, 2, 3)
    same = g.box(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert one.select(g.iou(same, same).alias("i")).first().i == 1
    v = one.select(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y")) for x in (0.0, 0.05, 3.0, 3.0)]).alias("v"))
    assert [p.x for p in v.select(g.without_repeats(F.col("v"), 0.1).alias("w")).first().w] == [0, 3]
    assert v.select(g.path_length(F.col("v"), True).alias("n")).first().n == 6
    up = one.select(g.arbitrary_axis(*[F.lit(x) for x in (0.0, 0.0, -1.0, 2.0, 3.0, 0.0)]).alias("p")).first().p
    assert (round(up.x, 9), round(up.y, 9)) == (-2, 3)
    m = F.array(*[F.lit(float(x)) for x in (2, 0, 0, 1, 0, 3, 0, 1, 0, 0, 1, 0, 0, 0, 0, 1)])
    assert tuple(one.select(g.affine_box(m, g.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("b")).first().b) == (1, 1, 3, 4)
    fit = g.fit_to_pixels(g.box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(5.0)), F.lit(100.0), F.lit(100.0))
    assert tuple(one.select(g.to_pixel(fit, F.lit(10.0), F.lit(0.0)).alias("p")).first().p) == (100, 100)
    far = g.anchored(g.box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)), F.lit(50.0), F.lit(50.0))
    assert tuple(one.select(far.alias("b")).first().b) == (49, 49, 51, 51)
    ring = one.select(g.ellipse_points(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(90.0), 4).alias("p")).first().p
    assert (round(ring[0].x, 9), round(ring[0].y, 9)) == (0, 2) and len(ring) == 5


def test_suppression_equals_the_walk(spark):
    from driftline.operators import regions

    rng = random.Random(8)
    boxes = [(i, rng.uniform(0, 20), rng.uniform(0, 4), rng.uniform(2, 6), rng.uniform(2, 4)) for i in range(150)]

    def iou(a, b):
        w = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        h = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        return w * h / (a[3] * a[4] + b[3] * b[4] - w * h)

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[3] * b[4], b[0])):
        if all(iou(b, k) <= 0.4 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "id long, x double, y double, w double, h double").select("id", F.lit(1).alias("sheet"), g.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box"))
    assert {r.id for r in regions.suppressed(df, ["sheet"], 3.0, 0.4).collect()} == {b[0] for b in kept}
    old, new = [b for b in boxes if b[0] % 2], [b for b in boxes if not b[0] % 2]
    free, want = dict.fromkeys(b[0] for b in new), {}
    for a in sorted(old, key=lambda b: (b[2], b[0])):
        best = max(((iou(a, b), -b[0]) for b in new if b[0] in free), default=(0, 0))
        if best[0] > 0.3:
            want[a[0]] = -best[1]
            free.pop(-best[1])
    got = regions.block_pairs(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), ["sheet"], 3.0, 0.3)
    assert {r.a_id: r.b_id for r in got.collect()} == want
    points = df.select("id", "sheet", F.col("box.x0").alias("x"), F.col("box.y0").alias("y"))
    at, free, want = {b[0]: (b[1], b[2]) for b in boxes}, {b[0] for b in new}, {}
    for i in sorted(b[0] for b in old):
        near = sorted((float(np.sqrt((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2)), j) for j in free)
        if near and near[0][0] <= 2:
            want[i] = near[0][1]
            free.remove(near[0][1])
    got = regions.truth_pairs(points.filter("id % 2 = 0"), points.filter("id % 2 = 1"), 2.0, ["sheet"])
    assert {r.truth_id: r.predicted_id for r in got.collect()} == want


def test_single_linkage_cut(spark):
    from driftline.operators import regions

    rows = [(i, "s", float(i % 3) + 100.0 * (i // 3)) for i in range(9)] + [(20, "t", 0.0)]
    df = spark.createDataFrame(rows, "id long, sheet string, x double").select("id", "sheet", g.box(F.col("x"), F.lit(0.0), F.col("x") + 0.5, F.lit(1.0)).alias("box"))
    assert {r.id: r.cluster for r in regions.ratio_cut(df, "sheet").collect()} == {**{i: i - i % 3 for i in range(9)}, 20: 20}


def test_sensitivity_settings():
    from driftline.functions.changes import Sensitivity

    assert Sensitivity.from_yaml("sensitivity: {preset: strict, scale: 0.5, other: 1}") == Sensitivity(position=0.1, dimension=0.1, dimension_rel=0.0001, rotation=0.01, scale=0.5, radius=5.0)
    assert Sensitivity.from_yaml("") == Sensitivity()


def test_curves_outlines_and_adapters(spark, tmp_path):
    from driftline.functions import keys

    one = spark.range(1)
    v = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(b).alias("bulge")) for x, y, b in ((0.0, 0.0, 0.5), (4.0, 0.0, 0.0), (4.0, 2.0, -1.0))])
    flat = one.select(keys.flattened(v, 2).alias("p")).first().p
    assert [(p.x, p.y) for p in flat] == [(0, 0), (2, 0), (4, 0), (4, 1), (4, 2)]
    back = one.select(keys.reversed_outline(v).alias("p")).first().p
    assert [(p.x, p.y, p.bulge) for p in back] == [(4, 2, 0), (4, 0, -0.5), (0, 0, 1)]
    (tmp_path / "d.json").write_text(json.dumps({"drawing": "D1", "units": "mm", "layers": [{"id": "1", "name": "BEAM"}], "entities": [{"id": "e", "type": "line", "layer_id": "1", "x": 1.0}, {"id": "f", "type": "text", "layer_id": "9"}]}, indent=1))
    assert [(r.id, r.layer_name) for r in records.read_adapter(spark, str(tmp_path / "d.json")).collect()] == [("e", "BEAM"), ("f", None)]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.txt").write_text("fine\nsee C:\\work\\x.dwg\n<path>/x.dwg\n")
    assert [r.value for r in records.audit_folder(spark, str(tmp_path / "out")).collect()] == ["see C:\\work\\x.dwg"]
    assert json.loads(records.manifest([{"stage": "a"}]))["schema_version"] == 1
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "hash_a string, hash_b string")
    assert records.new_pairs(pairs, pairs.limit(1)).count() == 1
