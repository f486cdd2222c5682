"""k8 over all stops, by brute force."""

import itertools

from dispatchgrid import catalog


def suppliers(spark, path, keys, nation=lambda k: 0):
    """A supplier table: stops get their place from the key and their route from the nation."""
    spark.createDataFrame([(k, nation(k)) for k in keys], "s_suppkey long, s_nationkey long").write.parquet(f"{path}/supplier.parquet")
    return {k: ((k * 7919) % 500 / 100.0, (k * 104729) % 500 / 100.0) for k in keys}


def test_hull_of_stops_beyond_forty(spark, tmp_path):
    at = suppliers(spark, tmp_path, [*range(30, 75), 541, 561])
    assert at[541] == at[41]
    places = set(at.values())
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = [(a, b) for a, b in itertools.permutations(places, 2) if all(cross(a, b, c) <= 1e-9 for c in places)]
    between = lambda p, a, b: abs(cross(a, b, p)) <= 1e-9 and (a[0] - p[0]) * (b[0] - p[0]) + (a[1] - p[1]) * (b[1] - p[1]) < 0
    corners = {p for e in edges for p in e if not any(between(p, a, b) for a, b in edges)}
    got = [r["stop"] for r in catalog.queries()["k8_hull"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(k for k, p in at.items() if p in corners) and max(got) > 40
