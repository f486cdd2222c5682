import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispatchgrid.functions import exprs as E
from dispatchgrid.operators import nearest as nn
from dispatchgrid.operators import robust, routing
from tests.conftest import DATA


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fleet_of_a_short_tour(spark):
    amortised, whole = E.fleet_sizes(F.lit(3.0), F.lit(1.0))
    assert value(spark, amortised) == pytest.approx(0.1)
    assert value(spark, whole) == 1.0
    assert value(spark, E.fleet_sizes(F.lit(0.0), F.lit(1.0))[1]) == 0.0


def test_newton_finds_the_minimum(spark):
    t = value(spark, E.dispatch_interval(F.lit(4.0), F.lit(1.5), F.lit(150.0), F.lit(1.0)))
    g = lambda c: 4 / c**2 + E.TOUR_CONSTANT * 150**0.5 * 1.5 / c + 1.5 * c + c * c
    c = t**0.5
    assert g(c) <= min(g(c * 0.999), g(c * 1.001))


def test_segment_distance_clamps(spark):
    assert value(spark, E.segment_distance(*(F.lit(float(x)) for x in (5, 0, 0, 0, 2, 0)))) == pytest.approx(3.0)
    assert value(spark, E.segment_distance(*(F.lit(float(x)) for x in (1, 2, 0, 0, 2, 0)))) == pytest.approx(2.0)
    assert value(spark, E.segment_distance(*(F.lit(float(x)) for x in (3, 4, 0, 0, 0, 0)))) == pytest.approx(5.0)


def test_walk_is_nothing_when_the_detour_reaches_all(spark):
    assert value(spark, E.mean_walk_km(F.lit(1.0), F.lit(1.0))) == 0.0
    assert value(spark, E.mean_walk_km(F.lit(1.0), F.lit(0.0))) == pytest.approx(2 / 3)


def test_nearest_by_cells_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)) * 10)]
    s = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((30, 2)) ** 3 * 10)]
    points, sites = spark.createDataFrame(p, "id int, x_km double, y_km double"), spark.createDataFrame(s, "site int, x_km double, y_km double")
    monkeypatch.setattr(nn, "BROADCAST_ROWS", 5)
    got = {r["id"]: r["pick"] for r in nn.nearest(points, sites, "id", "site").collect()}
    assert got == {i: min(s, key=lambda q: (round(((q[1] - x) ** 2 + (q[2] - y) ** 2) ** 0.5, 9), q[0]))[0] for i, x, y in p}


def test_worst_case_limits_and_monotone():
    d = np.abs(np.subtract.outer(np.arange(6), np.arange(6))).astype(float)
    p, w = np.array([0.5, 0.1, 0.1, 0.1, 0.1, 0.1]), np.ones(6)
    values = [robust.root_mass_worst_case(p, d, w, r)[0] for r in (0.0, 0.1, 0.5, 1.0, 10.0)]
    assert values[0] == pytest.approx(np.sqrt(p).sum())
    assert values[-1] == pytest.approx(6**0.5, abs=1e-4)
    assert all(a <= b + 1e-6 for a, b in itertools.pairwise(values))


def test_tours_order():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        x = rng.random((n, 2))
        d = np.hypot(*(x[:, None, k] - x[None, :, k] for k in (0, 1)))
        exact = min((routing.length(d, [0, *t]) for t in itertools.permutations(range(1, n))), default=0.0)
        assert routing.held_karp(d) == pytest.approx(exact)
        first = routing.nearest_neighbour(d)
        assert routing.spanning_tree(d) <= exact + 1e-9 <= routing.length(d, routing.two_opt(d, first)) + 2e-9 <= routing.length(d, first) + 3e-9


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert "o1_evaluate_design" in entry.queries()
    assert DATA
