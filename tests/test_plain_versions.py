"""Queries without SQL against plain versions on the same tables."""

import itertools
import math
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dispatchgrid import catalog
from dispatchgrid.operators.robust import worst_mean
from dispatchgrid.plans.region import Region

LARGER = "/root/testdata/sf0.01"
Q = catalog.queries()


@pytest.fixture(scope="module")
def cells():
    s = pd.read_parquet(f"{LARGER}/supplier.parquet")
    out = defaultdict(list)
    for k in sorted(s.s_suppkey):
        out[k % 12].append(((k * 7919) % 500 / 100.0, (k * 104729) % 500 / 100.0))
    return out


def tour(points):
    return sum(math.dist(a, b) for a, b in zip(points, points[1:] + points[:1], strict=True))


def tree(points):
    """Edges from the shortest on, those that join two parts."""
    part, total = list(range(len(points))), 0.0
    for d, i, j in sorted((math.dist(points[i], points[j]), i, j) for i, j in itertools.combinations(range(len(points)), 2)):
        if part[i] != part[j]:
            part = [part[i] if p == part[j] else p for p in part]
            total += d
    return total


def test_tours_and_trees(spark, cells):
    rows = {r["cell"]: r for r in Q["m2_two_opt"](spark, LARGER).collect()}
    assert set(rows) == set(cells)
    for c, points in cells.items():
        r = rows[c]
        exact = min(tour([points[0], *p]) for p in itertools.permutations(points[1:7])) if len(points) <= 7 else None
        left, own = points[1:], [points[0]]
        while left:
            own.append(min(left, key=lambda q: (round(math.dist(own[-1], q), 9), left.index(q))))
            left.remove(own[-1])
        assert r["n"] == len(points) and r["nn_km"] == pytest.approx(tour(own), abs=1e-5) and r["tree_km"] == pytest.approx(tree(points), abs=1e-5)
        assert r["tree_km"] <= r["tour_km"] + 1e-6 <= r["two_opt_km"] + 2e-6 <= r["nn_km"] + 3e-6
        assert exact is None or r["tour_km"] == pytest.approx(exact, abs=1e-5)
    assert {r["cell"]: r["tree_km"] for r in Q["k9_spanning_tree"](spark, LARGER).collect()} == {c: r["tree_km"] for c, r in rows.items()}
    assert {r["cell"]: r["tour_km"] for r in Q["m3_tour_switch"](spark, LARGER).collect()} == {c: r["tour_km"] for c, r in rows.items()}


def test_tours_of_eight_are_exact(spark, cells):
    rows = {r["cell"]: r["tour_km"] for r in Q["m3_tour_switch"](spark, LARGER).collect()}
    c, points = next((c, p) for c, p in sorted(cells.items()) if len(p) == 8)
    assert rows[c] == pytest.approx(min(tour([points[0], *p]) for p in itertools.permutations(points[1:])), abs=1e-5)


def test_lloyd_has_settled(spark):
    root = {r["block"]: r["root"] for r in Q["l6_lloyd_partition"](spark, LARGER).collect()}
    at = lambda b: (b % 5, b // 5)
    d = lambda a, b: round(math.dist(at(a), at(b)), 9)
    assert len(root) == 25
    for b, c in root.items():
        assert (d(b, c), c) == min((d(b, o), o) for o in set(root.values()))
    for c in set(root.values()):
        own = [b for b in root if root[b] == c]
        total = lambda m, own=own: round(sum(math.dist(at(m), at(b)) for b in own), 9)
        assert total(c) == min(map(total, own))


def test_worst_tours_are_certified_and_between_their_bounds(spark):
    low = {r["district"]: r["alpha"] for r in Q["l1_worst_tour_zero_radius"](spark, LARGER).collect()}
    for r in Q["l1_worst_tour"](spark, LARGER).collect():
        assert r["certified"] and low[r["district"]] - 1e-3 <= r["alpha"] <= math.sqrt(5.0) + 1e-3


def test_partition_queries_cover_all_blocks(spark):
    for name in ("l6_partition_search", "o10_spatial_only_search"):
        rows = Q[name](spark, LARGER).collect()
        assert sorted(r["block"] for r in rows) == list(range(25)) and len({r["root"] for r in rows}) == 5 and len({r["depot"] for r in rows}) == 1
        for r in rows:
            assert next(x["root"] for x in rows if x["block"] == r["root"]) == r["root"]


def places(n=None):
    s = pd.read_parquet(f"{LARGER}/supplier.parquet").sort_values("s_suppkey")
    return [(int(k), int(nation) % 3, (k * 7919) % 500 / 100.0, (k * 104729) % 500 / 100.0) for k, nation in zip(s.s_suppkey, s.s_nationkey, strict=True)]


def test_order_inside_subpaths(spark):
    routes = defaultdict(list)
    for _, route, x, y in places():
        routes[route].append((x, y))
    want = {}
    for route, points in routes.items():
        for k in range(0, len(points), 4):
            own = points[k : k + 4]
            order, left = [0], list(range(1, len(own)))
            while left:
                order.append(min(left, key=lambda j: (round(math.dist(own[order[-1]], own[j]), 9), j)))
                left.remove(order[-1])
            want[route * 100000 + k // 4] = (",".join(map(str, order)), round(sum(math.dist(own[a], own[b]) for a, b in itertools.pairwise(order)), 5))
    got = {r["part"]: (r["places"], round(r["km"], 5)) for r in Q["m7_order_in_subpath"](spark, LARGER).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(got[k][1] == pytest.approx(v[1], abs=2e-5) for k, v in want.items())


def test_depot_tours(spark, cells):
    for r in Q["m4_depot_tours"](spark, LARGER).collect():
        points = [(2.5, 2.5), *cells[r["cell"]]]
        assert r["n"] == len(points) and r["tree_km"] == pytest.approx(2 * tree(points), abs=1e-5) and r["tree_km"] / 2 <= r["tour_km"] <= r["tree_km"] + 1e-5


def test_studies_keep_their_bounds(spark):
    gap = sorted((r["radius"], r["lower"], r["upper"]) for r in Q["s11_bound_gap_by_radius"](spark, LARGER).collect())
    assert all(lo <= up + 2e-3 for _, lo, up in gap) and [lo for _, lo, _ in gap] == sorted(lo for _, lo, _ in gap)
    assert sum(r["share"] for r in Q["s15_worst_mass"](spark, LARGER).collect()) == pytest.approx(1.0, abs=0.02)
    assert all(r["nominal"] <= r["worst"] + 0.02 for r in Q["o22_sample_size_study"](spark, LARGER).collect())
    assert sum(r["n"] for r in Q["o12_equal_load"](spark, LARGER).collect()) == 1600
    assert all(r["above"] and r["certified"] for r in Q["l21_moment_problem"](spark, LARGER).collect())
    assert all(r["cost"] >= r["exact"] - 1e-6 for r in Q["l10_generated_ways"](spark, LARGER).collect())


def test_arrows_go_to_the_district_within_the_radius(spark):
    rows = Q["s25_transport_arrows"](spark, LARGER).collect()
    assert rows and all(r["dst"] % 5 == 0 and r["src"] % 5 for r in rows)
    assert sum(r["mass"] * math.dist((r["ax"], r["ay"]), (r["bx"], r["by"])) for r in rows) <= 0.5 + 1e-6


def test_arrows_use_up_the_radius(spark):
    """What the arrows carry is what the dual says that the district can gain: no plan gains more."""
    r = Region(spark, LARGER)
    inside = r.blocks().select("block", (F.col("x_km") == 0).cast("double").alias("v"))
    worst = worst_mean(inside, r.demand(), r.distances(), 0.5).first()["worst"]
    own = r.demand().join(inside, "block").agg(F.sum(F.col("p") * F.col("v"))).first()[0]
    assert own + sum(x["mass"] for x in Q["s25_transport_arrows"](spark, LARGER).collect()) == pytest.approx(worst, abs=1e-5)
