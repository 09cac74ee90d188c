import math
import random

import numpy as np

from cartomill.functions.kdtree import KdTree, assign, fit_cells
from cartomill.operators import nearby


def km(a, b):
    la, oa, lb, ob = map(math.radians, (*a, *b))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((oa - ob) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def places(spark, rows):
    return spark.createDataFrame([(k, a, o, "clash", 1) for k, a, o in rows], "key string, lat double, lon double, side string, cell int")


def test_kdtree_pairs_and_cells():
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.random((300, 3)), np.repeat(rng.random((1, 3)), 100, axis=0)])
    got = {(int(i), int(j)) for a, b in KdTree(pts, leaf=7).pairs(pts[:50], 0.2) for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(50) for j in range(400) if ((pts[i] - pts[j]) ** 2).sum() <= 0.04}
    nodes = fit_cells(pts, 13)
    rows, cells = assign(nodes, pts, pts)
    assert sorted(rows) == list(range(400)) and len(set(cells)) > 5
    assert fit_cells(np.zeros((0, 3)), 4) == [(-1, 0)]


def test_within_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearby, "CELL_ROWS", 40)
    monkeypatch.setattr(nearby, "BLOCK", 30)  # hot places are joined in blocks
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lat, lon = rng.choice([(0, 179.99), (89.99, 0), (-90, 10), (10, 10), (10, -179.99)])
        rows.append((f"p{i}", max(-90.0, min(90.0, lat + rng.gauss(0, 0.02))), max(-180.0, min(180.0, lon + rng.gauss(0, 0.02)))))
    rows += [(f"same{i}", 10.0, 10.0) for i in range(60)]
    bad = [("n1", None, 0.0), ("n2", float("nan"), 0.0), ("n3", 91.0, 0.0), ("n4", 0.0, 200.0), ("n5", 0.0, None)]
    df = places(spark, rows + bad)
    got = {(r.key_a, r.key_b) for r in nearby.within(df, df, 3.0).collect()}
    exp = {(a[0], b[0]) for a in rows for b in rows if km(a[1:], b[1:]) <= 3.0}
    assert got == exp
    one = nearby.within(df, None, 3.0).collect()
    assert {(r.key_a, r.key_b) for r in one} == exp and len(one) == len(exp)


SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
HOLE = [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0), (4.0, 4.0)]
LINE = [(170.0, -5.0), (-170.0, -5.0), (-170.0, 5.0), (170.0, 5.0), (170.0, -5.0)]
LINE_HOLE = [(-179.0, -1.0), (-179.0, 1.0), (-178.0, 1.0), (-178.0, -1.0), (-179.0, -1.0)]


def containing(spark, points, shapes):
    ring = lambda r: [{"x": x, "y": y} for x, y in r]
    areas = [(k, None if g is None else [[ring(r) for r in p] for p in g], "clash") for k, g in shapes]
    schema = "key string, geometry array<array<array<struct<x:double,y:double>>>>, lat string"
    return {(r.key_a, r.key_b) for r in nearby.containing(places(spark, points), spark.createDataFrame(areas, schema)).collect()}


def test_containing_borders_holes_and_antimeridian(spark):
    points = [
        ("in", 5.0, 2.0), ("edge", 0.0, 5.0), ("corner", 10.0, 10.0), ("hole", 5.0, 5.0), ("hole edge", 5.0, 4.0), ("out", 5.0, 11.0),
        ("east", 0.0, 179.0), ("west", 0.0, -179.5), ("line hole", 0.0, -178.5), ("on line", 0.0, 180.0), ("on line too", 0.0, -180.0), ("zero", 0.0, 0.0), ("lost", None, 5.0),
    ]
    shapes = [
        ("holed", [[SQUARE, HOLE]]), ("whole", [[SQUARE], [SQUARE]]), ("line", [[LINE, LINE_HOLE]]), ("null", None), ("empty", []), ("no ring", [[]]),
        ("short", [[SQUARE[:2]]]), ("nan", [[[(0.0, 0.0), (float("nan"), 0.0), (1.0, 1.0), (0.0, 0.0)]]]),
    ]
    got = containing(spark, points, shapes)
    both = {"in", "edge", "corner", "hole edge", "zero"}
    assert {a for a, b in got if b == "holed"} == both
    assert {a for a, b in got if b == "whole"} == both | {"hole"}
    assert {a for a, b in got if b == "line"} == {"east", "west", "on line", "on line too"}
    assert {b for _, b in got} == {"holed", "whole", "line"}


def test_sweep_against_ray_casting():
    rng = np.random.default_rng(3)
    polys = []
    for _ in range(20):
        angle = np.sort(rng.random(12) * 2 * np.pi)
        x, y = rng.random(2) * 10
        radius = rng.random(12) * 3 + 0.2
        xs, ys = x + radius * np.cos(angle), y + radius * np.sin(angle)
        polys.append((np.append(xs, xs[0]), np.append(ys, ys[0]), np.array([13])))
    px, py = np.sort(rng.random(500) * 10), rng.random(500) * 10
    got = set(zip(*(v.tolist() for v in nearby._sweep(px, py, polys))))
    exp = set()
    for k, (xs, ys, _) in enumerate(polys):
        for i in range(500):
            odd = sum((ys[j] > py[i]) != (ys[j + 1] > py[i]) and px[i] < xs[j] + (py[i] - ys[j]) * (xs[j + 1] - xs[j]) / (ys[j + 1] - ys[j]) for j in range(12))
            if odd % 2:
                exp.add((k, i))
    assert got == exp


def test_clipped_parts_hold_the_same_points():
    rng = np.random.default_rng(5)
    pts = rng.random((3000, 2)) * 10
    nodes = fit_cells(pts, 40)
    angle = np.sort(rng.random(2000) * 2 * np.pi)
    radius = 3 + rng.random(2000)
    ring = lambda r: nearby._closed(5 + r * np.cos(angle), 5 + r * np.sin(angle))
    rings = [ring(radius), ring(radius / 3)]
    order = np.argsort(pts[:, 0])
    pts = pts[order]
    whole = set(nearby._sweep(pts[:, 0], pts[:, 1], [(np.concatenate([r[0] for r in rings]), np.concatenate([r[1] for r in rings]), np.array([2001, 2001]))])[1].tolist())
    rows, cells = assign(nodes, pts, pts)
    got, sent = set(), 0
    for c, own in nearby._clipped(nodes, rings):
        here = np.sort(rows[cells == c])
        shape = (np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own]), np.array([len(r[0]) for r in own]))
        sent += len(shape[0])
        got |= set(here[nearby._sweep(pts[here, 0], pts[here, 1], [shape])[1]].tolist())
    assert got == whole and 500 < len(whole) < 2500
    # a cell gets its part of the edges, not all 4,002 points
    assert sent < 3 * 4002


def test_polygon_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nearby, "CELL_ROWS", 10)
    rng = random.Random(7)
    pts = [(f"p{i}", rng.choice([rng.uniform(-1, 11), 0.0, 5.0, 4.0, 10.0]), rng.choice([rng.uniform(-1, 11), 0.0, 5.0, 6.0, 10.0])) for i in range(400)]
    got = {a for a, b in containing(spark, pts, [("holed", [[SQUARE, HOLE]])])}
    in_hole = lambda y, x: 4 < x < 6 and 4 < y < 6
    assert got == {k for k, y, x in pts if 0 <= x <= 10 and 0 <= y <= 10 and not in_hole(y, x)}
    monkeypatch.setattr(nearby, "BLOCK_POINTS", 12)  # polygons are parted by their points, too
    assert {a for a, b in containing(spark, pts, [(f"s{i}", [[SQUARE, HOLE]]) for i in range(9)]) if b == "s3"} == got


def test_empty_tables(spark):
    assert containing(spark, [], [("a", [[SQUARE]])]) == set()
    assert containing(spark, [("a", 1.0, 1.0)], []) == set()
    assert nearby.within(places(spark, []), places(spark, [("a", 1.0, 1.0)]), 3.0).collect() == []


def test_found_counts_repeated_rows_once(spark):
    cities = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.001), (None, 1.0, 1.0)], "id bigint, lat double, lon double")
    geom = [[[{"x": x, "y": y} for x, y in SQUARE]]]
    areas = spark.createDataFrame([("A", geom, {"x": 1.0, "y": 1.0}), ("A", geom, {"x": 1.0, "y": 1.0}), (None, geom, None)], "areaId string, geometry array<array<array<struct<x:double,y:double>>>>, centroid struct<x:double,y:double>")
    got = sorted(tuple(r) for r in nearby.found(cities, areas).collect())
    assert got == [("centre", 1, "A"), ("centre", 2, "A"), ("inside", 1, "A"), ("inside", 2, "A"), ("near", 1, "2")]
