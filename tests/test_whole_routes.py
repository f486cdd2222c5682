"""m5, s4 and c9 over whole routes, against loops."""

import math

import pytest

from dispatchgrid import catalog


def suppliers(spark, path, keys, nation=lambda k: 0):
    """A supplier table: stops get their place from the key and their route from the nation."""
    spark.createDataFrame([(k, nation(k)) for k in keys], "s_suppkey long, s_nationkey long").write.parquet(f"{path}/supplier.parquet")
    return {k: ((k * 7919) % 500 / 100.0, (k * 104729) % 500 / 100.0) for k in keys}


def test_path_and_trips_reach_the_last_checkpoint(spark, tmp_path):
    sizes = {0: 20, 1: 1, 2: 5}
    route = dict(enumerate([r for r, n in sizes.items() for _ in range(n)], 1))
    at = suppliers(spark, tmp_path, route, route.get)
    want = {}
    for r in sizes:
        p = [at[k] for k in sorted(at) if route[k] == r]
        cost = [0.0]
        for i in range(1, len(p)):
            cost.append(min(cost[j] + math.dist(p[i], p[j]) for j in range(max(0, i - 3), i)))
        want[r] = cost[-1]
    got = {r["route"]: r["km"] for r in catalog.queries()["m5_skip_limited_path"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    trips = [(r["route"], r["headway_h"], r["seq"], r["offset_h"]) for r in catalog.queries()["s4_reference_trips"](spark, str(tmp_path)).collect()]
    assert sorted(trips) == sorted((r, t, i, pytest.approx(t + (i - 1) * 0.05, abs=1e-6)) for r, n in sizes.items() for t in (0.25, 0.5, 1.0) for i in range(1, n + 1))


def test_late_segments_touch_blocks(spark, tmp_path):
    # Seven stops near one corner, and one at the end of the route far from it.
    place = lambda k: ((k * 7919) % 500 / 100.0, (k * 104729) % 500 / 100.0)
    near = [k for k in range(1, 500) if max(place(k)) < 0.9][:7]
    last = next(k for k in range(501, 1001) if min(place(k)) > 4.1)
    at = suppliers(spark, tmp_path, [*near, last])
    spark.createDataFrame([(i, i % 5) for i in range(25)], "n_nationkey long, n_regionkey long").write.parquet(str(tmp_path / "nation.parquet"))
    p = [at[k] for k in sorted(at)]
    touches = lambda a, b, x, y: min(a[0], b[0]) <= x + 1 and max(a[0], b[0]) >= x and min(a[1], b[1]) <= y + 1 and max(a[1], b[1]) >= y
    want = {n: any(touches(a, b, n % 5, n // 5) for a, b in zip(p, p[1:])) for n in range(25)}
    got = {r["block"]: r["near_line"] for r in catalog.queries()["c9_segment_touches_block"](spark, str(tmp_path)).collect()}
    assert len(near) == 7 and got == want and want[24]
