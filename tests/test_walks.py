"""Queries without SQL against plain walks over the same tables."""

from difflib import SequenceMatcher

import pytest

from driftline.operators import zones as zone_operators
from driftline.queries import QUERIES, regions, sheets, spatial, zones
from driftline.queries.common import table

SF = "/root/testdata/sf0.001"


def walk(edges, order):
    """Edges (a, b, ...) taken in order while both ends are free."""
    one, two, out = set(), set(), []
    for e in sorted(edges, key=order):
        if e[0] not in one and e[1] not in two:
            one.add(e[0])
            two.add(e[1])
            out.append(e)
    return out


def gap_and_iou(a, b):
    dx, dy = max(a.x0 - b.x1, b.x0 - a.x1, 0), max(a.y0 - b.y1, b.y0 - a.y1, 0)
    w, h = max(min(a.x1, b.x1) - max(a.x0, b.x0), 0), max(min(a.y1, b.y1) - max(a.y0, b.y0), 0)
    area = lambda x: (x.x1 - x.x0) * (x.y1 - x.y0)
    return (dx * dx + dy * dy) ** 0.5, w * h / (area(a) + area(b) - w * h), area


def test_greedy_pairs(spark):
    near = [(r.a_id, r.b_id, r.distance) for r in spatial._near(spark, SF).collect()]
    want = {(a, b) for a, b, _ in walk(near, lambda e: (e[2], e[0], e[1]))}
    assert {(r.a_id, r.b_id) for r in QUERIES["greedy_pairs"](spark, SF).collect()} == want and want


def test_hungarian_pairs(spark):
    """Most edges, then least cost, by shortest augmenting paths (each adds one edge as cheaply as can be)."""
    near = {}
    for r in spatial._near(spark, SF).collect():
        near.setdefault(r.a_id, {})[r.b_id] = r.distance
    match_a, match_b = {}, {}
    while True:
        dist = {("a", a): (0.0, None) for a in near if a not in match_a}
        changed = True
        while changed:
            changed = False
            for a, edges in near.items():
                if ("a", a) not in dist:
                    continue
                base = dist["a", a][0]
                for b, d in edges.items():
                    if match_a.get(a) != b and base + d < dist.get(("b", b), (float("inf"),))[0] - 1e-12:
                        dist["b", b], changed = (base + d, ("a", a)), True
            for b, a in match_b.items():
                if ("b", b) in dist and dist["b", b][0] - near[a][b] < dist.get(("a", a), (float("inf"),))[0] - 1e-12:
                    dist["a", a], changed = (dist["b", b][0] - near[a][b], ("b", b)), True
        free = [(d, n) for n, (d, _) in dist.items() if n[0] == "b" and n[1] not in match_b]
        if not free:
            break
        node = min(free)[1]
        while node is not None:
            before = dist[node][1]
            if node[0] == "b":
                match_a[before[1]], match_b[node[1]] = node[1], before[1]
            node = before
    rows = QUERIES["hungarian_pairs"](spark, SF).collect()
    assert len(rows) == len(match_a) and len({r.a_id for r in rows}) == len(rows) == len({r.b_id for r in rows})
    assert sum(near[r.a_id][r.b_id] for r in rows) == pytest.approx(sum(near[a][b] for a, b in match_a.items()))


def test_rigid_transform(spark):
    assert tuple(QUERIES["rigid_transform"](spark, SF).first()) == (12500, -3000, 7000, 1000)


def test_sequence_ratio(spark):
    rows = {r.p_partkey: r.ratio_micro for r in QUERIES["sequence_ratio"](spark, SF).collect()}
    for p in table(spark, SF, "part").collect():
        assert rows[p.p_partkey] == round(SequenceMatcher(None, p.p_name.upper(), p.p_type).ratio() * 1e6)


def _boxes(spark):
    out = {}
    for r in regions._boxes(spark, SF).collect():
        out.setdefault(r.sheet, []).append(r)
    return out


def test_frame_suppression(spark):
    want = set()
    for sheet in _boxes(spark).values():
        kept = []
        for r in sorted(sheet, key=lambda r: (-gap_and_iou(r.box, r.box)[2](r.box), r.id)):
            if all(gap_and_iou(r.box, k.box)[1] <= 0.3 for k in kept):
                kept.append(r)
        want |= {r.id for r in kept}
    assert {r.id for r in QUERIES["frame_suppression"](spark, SF).collect()} == want


def test_ratio_cut(spark):
    rows = {r.sheet: (r.n, r.clusters) for r in QUERIES["ratio_cut"](spark, SF).collect()}
    for name, sheet in _boxes(spark).items():
        edges = sorted((gap_and_iou(a.box, b.box)[0], i, j) for i, a in enumerate(sheet) for j, b in enumerate(sheet[:i]))
        label, merges = list(range(len(sheet))), []
        for d, i, j in edges:
            if label[i] != label[j]:
                merges.append(d)
                label = [label[j] if x == label[i] else x for x in label]
        jumps = [y / max(x, 1.0) for x, y in zip(merges, merges[1:], strict=False)]
        limit = merges[jumps.index(max(jumps))] if jumps and max(jumps) >= 3 else float("inf")
        label = list(range(len(sheet)))
        for d, i, j in edges:
            if d <= limit and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
        assert rows[name] == (len(sheet), len(set(label)))


def test_text_block_pairs(spark):
    want = set()
    for sheet in _boxes(spark).values():
        edges = [(a.id, b.id, a.box.y0, gap_and_iou(a.box, b.box)[1]) for a in sheet if a.id % 2 == 0 for b in sheet if b.id % 2 == 1]
        want |= {(a, b) for a, b, *_ in walk([e for e in edges if e[3] > 0.2], lambda e: (e[2], e[0], -e[3], e[1]))}
    assert {(r.a_id, r.b_id) for r in QUERIES["text_block_pairs"](spark, SF).collect()} == want


def test_truth_matching(spark):
    a, b = (x.collect() for x in spatial._points(spark, SF))
    edges = [(t.id, p.id, ((t.x - p.x) ** 2 + (t.y - p.y) ** 2) ** 0.5) for t in a if t.id % 3 == 0 for p in b if t.kind == p.kind]
    want = {e[:2] for e in walk([e for e in edges if e[2] <= 1], lambda e: (e[0], e[2], e[1]))}
    assert {(r.truth_id, r.predicted_id) for r in QUERIES["truth_matching"](spark, SF).collect()} == want and want


def test_relocation_links(spark):
    edges = [(r.a_id, r.b_id, r.size_diff, r.distance) for r in zone_operators.relocation_candidates(zones._sized_zones(spark, SF)).collect()]
    want = {e[:2] for e in walk(edges, lambda e: (e[2], e[3], e[0], e[1]))}
    assert {(r.a_id, r.b_id) for r in QUERIES["relocation_links"](spark, SF).collect()} == want and want


def test_viewport_regions(spark):
    entities = {}
    for r in sheets._entities(spark, SF).collect():
        entities.setdefault(r.sheet, []).append(r)
    got = {(r.sheet, r.id) for r in QUERIES["viewport_regions"](spark, SF).collect()}
    views = [r.s_suppkey for r in table(spark, SF, "supplier").collect() if r.s_suppkey < 30]
    assert {s for s, _ in got} <= set(entities)
    for sheet in entities:
        # views of one column overlap wholly unless their widths differ by over 15 per cent, which they don't
        columns = {}
        for v in views:
            columns.setdefault(v % 5, []).append(v)
        for members in columns.values():
            held = [v for v in members if (sheet, v) in got]
            widths = {v: 500 + v % 7 * 10 for v in members}
            assert len(held) <= 1 and all(widths[held[0]] >= max(w for v, w in widths.items() if (sheet, v) in got) for _ in held)


def test_every_query_without_sql_has_a_walk():
    from driftline.queries import ORACLE_SQL

    names = {n[5:] for n in globals() if n.startswith("test_")}
    assert set(QUERIES) - set(ORACLE_SQL) <= names
