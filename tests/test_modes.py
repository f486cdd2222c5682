"""Planned modes and partitions against small cases with known answers and against enumeration."""

import itertools

import numpy as np
import pytest

from dispatchgrid.operators import detours, fans, partition, pooled, studies, waves
from dispatchgrid.plans.region import Region
from tests.conftest import DATA


@pytest.fixture(scope="module")
def region(spark):
    return partition.problem(partition.one_row(Region(spark, DATA)).first())


def test_cut_loop_ends_at_the_least(region):
    x = partition.corner(region)
    history, best, found = partition.cut_loop(x)
    assert best == pytest.approx(partition.exact_pair(x), abs=1e-2)
    assert all(b <= best + 1e-9 and b <= c + 1e-9 for (_, b, _), (_, c, _) in itertools.pairwise(history))
    assert sorted(i for m, _, _ in found for i in m) == list(range(9))


def test_no_swap_improves_a_restart(region):
    cost, centers, groups = region.restart(3, 1)
    assert sorted(i for g in groups for i in g) == list(range(25))
    for c in centers:
        for n in region.near[c]:
            if n not in centers:
                assert region.value(region.deal(tuple(sorted({*centers, n} - {c}))))[0] >= cost - 1e-9


def test_restarts_come_near_the_best_centers(region):
    small = partition.corner(region)
    least = min(small.value(small.deal(c))[0] for c in itertools.combinations(range(9), 2))
    assert min(small.restart(2, s)[0] for s in range(6)) == pytest.approx(least)


def test_interval_is_cheapest():
    t = partition.best_interval(4.0, 1.5, 1.0, 10.0)
    g = lambda t: 4 / t + 1.5 / t**0.5 + 0.15 * t**0.5 + t
    assert g(t) <= min(g(t * 0.99), g(t * 1.01))


def test_robust_cost_rises_with_the_radius(region):
    m = (0, 1, 5, 6)
    costs = []
    for radius in (0.0, 0.3, 1.0):
        x = partition.Problem(region.ids, region.km, region.p, region.area, region.omega, region.near, radius)
        costs.append(x.district(m, 1.0)["cost"])
    assert costs == sorted(costs) and costs[0] < costs[2]


def batch(goal, release, deadline, **rules):
    return pooled.Batch(np.array(goal, float), np.array(release, float), np.array(deadline, float), np.zeros(2), pooled.Rules(**rules))


def test_a_request_alone_waits_for_the_horizon():
    alone = batch([[1.0, 0.0]], [0.25], [1.0]).alone(0)
    assert (alone.km, alone.wait, alone.walk) == (2.0, 0.75, 0.0) and alone.ride == pytest.approx(1 / 30)
    m = batch([[1.0, 0.0]], [0.4], [1.0], fleet=0).metrics()
    assert m["wait_h"] == pytest.approx(0.6) and m["km"] == pytest.approx(2.0) and m["ride_h"] == pytest.approx(1 / 30) and m["walk_h"] == 0.0


def test_costs_over_scenarios(spark):
    stats = spark.createDataFrame([(0, 5, 0, 0.5, 0.1, 0.2, 12.0), (1, 5, 0, 0.7, 0.2, 0.4, 8.0)], pooled._STATS)
    r = pooled.pooled_costs(stats, pooled.Rules(fleet=3, horizon_h=2.0), 4.0).first()
    assert (r["wait_h"], r["walk_h"], r["ride_h"], r["km_per_h"], r["provider_cost"], r["raw_fleet"]) == (0.6, 0.15, 0.3, 5.0, 17.0, 3)
    assert r["fleet"] == pytest.approx(10 / 60, abs=1e-6)


def test_meeting_points_stay_within_the_walk_and_shorten_the_way():
    rng = np.random.default_rng(0)
    for _ in range(20):
        goal = rng.random((4, 2)) * 3
        stops = pooled.meeting_points(goal, np.zeros(2), 0.3)
        way = lambda p: np.hypot(*np.diff(np.vstack([[0, 0], p, [0, 0]]), axis=0).T).sum()
        assert np.hypot(*(stops - goal).T).max() <= 0.3 + 1e-9 and way(stops) <= way(goal) + 1e-9


def test_small_batches_are_planned_no_worse_than_greedily():
    rng = np.random.default_rng(1)
    for _ in range(15):
        n = int(rng.integers(1, 5))
        b = batch(rng.random((n, 2)) * 4, rng.random(n) * 0.3, 0.3 + rng.random(n) * 0.6, fleet=2, capacity=2)
        order = sorted(range(n), key=lambda i: (b.release[i], i))
        score = lambda s: (len(s[1]), round(sum(r.cost(1) for r in s[0]) + sum(b.alone(i).cost(1) for i in s[1]), 6))
        routes, left = b.plan()
        assert score((routes, left)) <= score(b._greedy(order, [pooled.Route()] * 2))
        assert sorted([*left, *(i for r in routes for i in r.order)]) == list(range(n))


def grid(n):
    rng = np.random.default_rng(n)
    x = rng.random((n, 2)) * 4
    return np.hypot(*(x[:, None, k] - x[None, :, k] for k in (0, 1)))


def plain_routes(d, q, vehicles, capacity):
    """Every way to put the places in order and to cut the order into routes."""
    best = np.inf
    for order in itertools.permutations(range(1, len(d))):
        for cuts in itertools.product((0, 1), repeat=len(order) - 1):
            parts, own = [], [order[0]]
            for place, cut in zip(order[1:], cuts, strict=True):
                if cut:
                    parts.append(own)
                    own = []
                own.append(place)
            parts.append(own)
            if len(parts) <= vehicles and all(q[p].sum() <= capacity for p in parts):
                best = min(best, sum(d[[0, *p], [*p, 0]].sum() for p in parts))
    return best


def test_exact_routes_equal_all_ways():
    for n in (2, 3, 4, 5, 6):
        d, q = grid(n), np.array([0.0, *np.random.default_rng(n).integers(1, 4, n - 1)])
        for vehicles, capacity in ((1, 100), (2, 5), (3, 4)):
            plan = waves.exact_routes(d, q, vehicles, capacity)
            want = plain_routes(d, q, vehicles, capacity)
            assert (plan is None) == np.isinf(want)
            if plan is not None:
                assert sum(d[[0, *r], [*r, 0]].sum() for r in plan) == pytest.approx(want)
                assert sorted(i for r in plan for i in r) == list(range(1, n)) and all(q[r].sum() <= capacity for r in plan)


def test_joined_routes_serve_all_and_are_no_shorter():
    d, q = grid(8), np.array([0.0] + [1.0] * 7)
    for vehicles in (1, 2, 3):
        plan = waves.joined_routes(d, q, vehicles, 4)
        assert sorted(i for r in plan for i in r) == list(range(1, 8)) and len(plan) <= vehicles
    exact = waves.exact_routes(d, q, 2, 4)
    assert sum(d[[0, *r], [*r, 0]].sum() for r in exact) <= sum(d[[0, *r], [*r, 0]].sum() for r in waves.joined_routes(d, q, 2, 4)) + 1e-9


def test_fleet_plan_equals_all_plans():
    table = [(0, 9.0, 1), (1, 5.0, 1), (2, 3.0, 2), (3, 2.0, 3)]
    away = {k: a for k, _, a in table}
    hours = {k: h for k, h, _ in table}
    for fleet in (1, 2, 3, 4):
        best = np.inf
        for plan in itertools.product(range(4), repeat=5):
            out = [sum(k for j, k in enumerate(plan[: m + 1]) if away[k] > m - j) for m in range(5)]
            if max(out) <= fleet:
                best = min(best, sum(hours[k] for k in plan))
        cost, plan = waves.fleet_plan(table, fleet, 5)
        assert cost * 5 == pytest.approx(best) == pytest.approx(sum(hours[k] for k in plan))


def test_cuts_share_the_load():
    rng = np.random.default_rng(4)
    x, y = rng.random((2, 900)) * 5
    tour, ride = rng.random(900), rng.random(900) * (1 + x)
    for share in (0.5, 0.25):
        side = fans.line_split(x, y, tour, ride, share)
        assert tour[side].sum() / tour.sum() == pytest.approx(share, abs=0.01) and ride[side].sum() / ride.sum() == pytest.approx(share, abs=0.02)
    out = fans.divide(x, y, tour, ride, 5)
    assert set(out) == set(range(5))
    assert all(tour[out == k].sum() / tour.sum() == pytest.approx(0.2, abs=0.05) for k in range(5))


A, B, C = np.array([0.0, 0.0]), np.array([1.0, 0.5]), np.array([2.0, 0.0])


def test_access_and_way_of_a_line():
    cp = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 1.0]])
    assert detours.access_km(cp, np.zeros(2)) == pytest.approx(1.0)
    assert detours.access_km(cp, np.zeros(2)) + detours.least_way(cp, 1) == pytest.approx(2.0)


def test_arcs_by_reach_slack_and_skips():
    line, stops = np.stack([A, C]), B[None, :]
    served = lambda **r: {s for *_, s, _ in detours.arcs(line, stops, detours.Rules(**r))}
    assert served(reach_km=0.0) == {()} and served(reach_km=0.8, slack=0.5) == {(), (0,)} and served(reach_km=0.8, slack=0.0) == {()}
    three = np.stack([A, B, C])
    ends = lambda skip: {a[:2] for a in detours.arcs(three, np.zeros((0, 2)), detours.Rules(skip=skip))}
    assert (0, 2) not in ends(0) and (0, 2) in ends(1)
    assert detours.reachable(line, stops, detours.Rules(reach_km=0.8)).all() and not detours.reachable(line, stops, detours.Rules(reach_km=0.8, slack=0.0)).any()


def test_riders_at_stops_that_are_not_served_walk_to_a_checkpoint():
    xy = np.array([[0.0, 0.0], [1.0, 0.0]])
    out = detours.evaluate(np.array([[1.1, 0.0]]), [detours.Line((0,), (1,), 1.0)], xy, np.array([-12.0, 0.0]), detours.Rules())
    assert out["walk_km"] == pytest.approx(1.1) and out["ride_h"] == pytest.approx(0.4) and out["reassigned"] == 1
    out = detours.evaluate(np.array([[0.0, 0.0]]), [detours.Line((0,), (), 1.0)], xy, np.array([-6.0, 0.0]), detours.Rules())
    assert out["walk_km"] == 0.0 and out["ride_h"] == pytest.approx(0.2) and out["reassigned"] == 0


def test_plan_equals_all_ways():
    rng = np.random.default_rng(6)
    for _ in range(12):
        cp, stops = np.cumsum(rng.random((4, 2)) + 0.3, axis=0), rng.random((5, 2)) * 4
        load, penalty = rng.integers(1, 4, 5).astype(float), rng.random(5) * 3
        rules = detours.Rules(reach_km=1.0, slack=1.0, skip=1, capacity=5)
        ways = detours.arcs(cp, stops, rules)
        best = np.inf

        def walk(i, served, cost, cp=cp, ways=ways, load=load, penalty=penalty):
            nonlocal best
            if i == len(cp) - 1:
                best = min(best, cost + sum(p for s, p in enumerate(penalty) if s not in served))
            for a, j, own, km in ways:
                if a == i and not served & set(own) and sum(load[s] for s in served | set(own)) <= 5:
                    walk(j, served | set(own), cost + km)

        walk(0, set(), 0.0)
        cost, km, served, path = detours.plan(cp, stops, load, penalty, rules, 1.0)
        assert cost == pytest.approx(best) and cost == pytest.approx(km + sum(p for s, p in enumerate(penalty) if s not in served))


def test_branching_equals_enumeration(region):
    x = partition.corner(region)
    best, one, _ = studies.best_pair(x)
    cost = lambda m: x.district(m, float(x.km[0, list(m)].min()))["cost"]
    ways = [(tuple(i for i in range(9) if not m >> i & 1), tuple(i for i in range(9) if m >> i & 1)) for m in range(1, 2**9 - 1)]
    assert best == pytest.approx(min(max(cost(a), cost(b)) for a, b in ways)) and 0 < len(one) < 9


def test_map_of_plane_distances_is_exact():
    p = np.random.default_rng(2).random((12, 2)) * 5
    d = np.hypot(*(p[:, None, k] - p[None, :, k] for k in (0, 1)))
    at, stress = studies.embedded(d)
    assert stress < 1e-9 and np.hypot(*(at[:, None, k] - at[None, :, k] for k in (0, 1))) == pytest.approx(d, abs=1e-9)


def test_exponential_fit_recovers_a_curve():
    x = np.arange(5.0, 50.0, 4.0)
    for a, b, c in ((2.0, 0.08, 1.0), (5.0, -0.1, 3.0)):
        assert studies.exponential_fit(x, a * np.exp(b * x) + c) == pytest.approx((a, b, c), rel=1e-3)


def test_generated_ways_reach_the_plan_over_all():
    rng = np.random.default_rng(9)
    for _ in range(15):
        cp = np.array([[0.0, 0.0], [2.0, 0.0], [4.0, 0.0], [6.0, 0.0]])
        stops = np.array([[1.0, 0.3], [3.0, -0.4], [5.0, 0.5], [3.0, 0.3]]) + rng.random((4, 2)) * 0.2
        penalty, rules = rng.random(4) * 3, detours.Rules(slack=1.0, capacity=100)
        cost, rounds, used = detours.generated(cp, stops, np.ones(4), penalty, rules, 1.0)
        assert cost == pytest.approx(detours.plan(cp, stops, np.ones(4), penalty, rules, 1.0)[0]) and used <= len(detours.arcs(cp, stops, rules))
