"""Unions, point and line joins and nearest segments against brute force on random shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dispatchgrid.operators import polygons as P
from dispatchgrid.operators.nearest import nearest_segment

EDGES = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def ring(cx, cy, radius, n, seed):
    rng = random.Random(seed)
    p = [(cx + radius * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + radius * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [(*p[k], *p[(k + 1) % n]) for k in range(n)]


def odd_polygons():
    """Concave rings with holes, one inside another's hole, one far off, one without edges, a comb that spans many cells."""
    comb = [(x, 9.0 if x % 2 else 0.5) for x in range(12)] + [(11.5, -1.0), (-0.5, -1.0)]
    out = {1: ring(4, 4, 4, 17, 1) + ring(4, 4, 1, 5, 2), 2: ring(6, 6, 3, 40, 3), 3: ring(4, 4, 0.8, 7, 4), 4: ring(90, 90, 3, 9, 5), 5: []}
    out[6] = [(*comb[k], *comb[(k + 1) % len(comb)]) for k in range(len(comb))]
    return {k: [tuple(map(float, e)) for e in v] for k, v in out.items()}


def inside(x, y, edges):
    return sum((ay <= y) != (by <= y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in edges) % 2 == 1


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(list(odd_polygons().items()), f"pid int, edges {EDGES}")


@pytest.mark.parametrize("least", [1, 5, 64])
def test_points(spark, shapes, least):
    rng = random.Random(7)
    at = [(rng.uniform(-2, 12), rng.uniform(-2, 12)) for _ in range(1500)]
    at += [(rng.gauss(4, 0.01), rng.gauss(4, 0.01)) for _ in range(800)] + [(4.0, 4.0)] * 200  # a hot cell
    at += [(a[0], a[1]) for e in odd_polygons().values() for a in e[:5]] + [(float(k), 0.5) for k in range(12)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(-1, None, 3.0)], "id int, x double, y double")
    got = {(r["id"], r["pid"]) for r in P.points_in_polygons(points, shapes, "x", "y", "pid", least=least).collect()}
    assert got == {(i, k) for i, p in enumerate(at) for k, e in odd_polygons().items() if inside(*p, e)}


def test_no_points(spark, shapes):
    assert P.points_in_polygons(spark.createDataFrame([], "id int, x double, y double"), shapes, "x", "y", "pid").count() == 0


def meet(a, b):
    side = lambda p, q, r: (lambda v: (v > 0) - (v < 0))((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    p, q, r, s = a[:2], a[2:], b[:2], b[2:]
    boxes = all(min(p[k], q[k]) <= max(r[k], s[k]) and min(r[k], s[k]) <= max(p[k], q[k]) for k in (0, 1))
    return boxes and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0


def odd_lines():
    rng = random.Random(9)
    out = [(a := rng.uniform(-3, 13), b := rng.uniform(-3, 13), a + rng.gauss(0, 1), b + rng.gauss(0, 1)) for _ in range(300)]
    return out + [(3.0, -5.0, 3.0, 20.0), (-5.0, 2.0, 20.0, 2.0), (4.0, 4.0, 4.0, 4.0), (0.0, 0.5, 1.0, 9.0), (50.0, 50.0, 51.0, 50.0), (-20.0, -20.0, 100.0, 100.0)]


def test_lines(spark, shapes):
    lines = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(odd_lines())], "id int, ax double, ay double, bx double, by double")
    got = [(r["id"], r["pid"]) for r in P.lines_in_polygons(lines, shapes, "id", "pid").collect()]
    want = {(i, k) for i, x in enumerate(odd_lines()) for k, e in odd_polygons().items() if inside(*x[:2], e) or any(meet(x, f) for f in e)}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_segment(spark):
    lines = odd_lines()
    rng = random.Random(3)
    points = [(rng.uniform(-5, 15), rng.uniform(-5, 15)) for _ in range(200)] + [(400.0, -300.0), (4.0, 4.0)]

    def km(p, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = 0.0 if dx * dx + dy * dy <= 0 else max(0.0, min(1.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy)

    frame = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(lines)], "sid int, ax double, ay double, bx double, by double")
    at = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, x_km double, y_km double")
    found = nearest_segment(at, frame, "id", "sid")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["pick"], r["km"]) for r in found.collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        pick, least = min(range(len(lines)), key=lambda k: (round(km(p, lines[k]), 9), k)), min(km(p, s) for s in lines)
        assert abs(got[i][1] - least) < 1e-9 and got[i][0] == pick


def test_rings_with_a_hole_and_touching_corners(spark):
    rng = random.Random(2)
    cells = {1: {(x, y) for x in range(5) for y in range(5)} - {(2, 2), (1, 3)}, 2: {(0, 0), (1, 1)}, 3: {(x, y) for x in range(30) for y in range(30) if rng.random() < 0.6}}
    frame = spark.createDataFrame([(g, x, y) for g, c in cells.items() for x, y in c], "g int, x int, y int")
    sides = frame.select("g", F.explode(P.square_edges(F.col("x"), F.col("y"))).alias("e")).select("g", "e.*")
    found = P.rings(P.boundary(sides, "g"), "g").collect()
    for g, c in cells.items():
        own = [r for r in found if r["g"] == g]
        assert sum(r["area"] for r in own) == len(c)
        sides_ = 0
        for r in own:
            p = [(v["x"], v["y"]) for v in r["ring"]]
            steps = [abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(p, [*p[1:], p[0]], strict=True)]
            assert set(steps) == {1.0}
            sides_ += len(p)
            assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True)) / 2 - r["area"]) < 1e-9
        assert sides_ == sum((x + dx, y + dy) not in c for x, y in c for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    assert sorted(r["area"] for r in found if r["g"] == 1) == [-1.0, -1.0, 25.0] or sorted(r["area"] for r in found if r["g"] == 1) == [-2.0, 25.0]
    assert sorted(r["area"] for r in found if r["g"] == 2) == [1.0, 1.0]
