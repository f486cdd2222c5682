"""Tours over places against tours over all points, step by step."""

import math
import random
import time

import pytest

from dispatchgrid.operators import routing
from dispatchgrid.operators.routing import Plane, length, nearest_neighbour, per_places, spanning_tree, tour_length, two_opt


def plain(points):
    """Nearest left, ties to the first, and first improving reversals."""
    d = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    left, t = points[1:], [points[0]]
    while left:
        t.append(left.pop(min(range(len(left)), key=lambda j: (round(d(t[-1], left[j]), 9), j))))
    way = lambda: sum(d(a, b) for a, b in zip(t, t[1:] + t[:1], strict=True))
    first, n = way(), len(t)
    for _ in range(100):
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                a, b, c, e = t[i - 1], t[i], t[j], t[(j + 1) % n]
                if d(a, c) + d(b, e) < d(a, b) + d(c, e) - 1e-12:
                    t[i : j + 1], better = t[i : j + 1][::-1], True
        if not better:
            return first, way()
    return first, way()


def test_places_of_many_points(spark):
    rng = random.Random(3)
    at = [(rng.randrange(40) / 10, rng.randrange(40) / 10) for _ in range(60)]
    rows = [(g, i, *rng.choice(at[: 5 + 55 * (g > 0)])) for g in range(3) for i in range(9 if g == 0 else 150)]

    def f(d, n):
        nn = nearest_neighbour(d)
        return {"n": n, "places": len(d), "nn": length(d, nn), "opt": length(d, two_opt(d, nn)), "tour": tour_length(d, n), "tree": spanning_tree(d)}

    got = {r["g"]: r for r in per_places(spark.createDataFrame(rows, "g int, k long, x_km double, y_km double"), "g", "k", f, "n long, places long, nn double, opt double, tour double, tree double").collect()}
    for g in range(3):
        points = [r[2:] for r in rows if r[0] == g]
        first, improved = plain(points)
        assert (got[g]["n"], got[g]["places"]) == (len(points), len(set(points)))
        assert (got[g]["nn"], got[g]["opt"]) == (pytest.approx(first, abs=1e-9), pytest.approx(improved, abs=1e-9))
        assert got[g]["tour"] <= improved + 1e-9 and got[g]["tree"] <= got[g]["tour"] + 1e-9


def test_thousands_of_places_take_seconds():
    rng = random.Random(4)
    d = Plane(*(routing.np.array([rng.random() for _ in range(1500)]) for _ in range(2)))
    begun = time.time()
    assert spanning_tree(d) < length(d, two_opt(d, nearest_neighbour(d))) < length(d, nearest_neighbour(d))
    assert time.time() - begun < 60
