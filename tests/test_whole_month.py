"""i2 and i3 over all six-hour scenarios, against a heap and a loop."""

import heapq
import math
from collections import defaultdict

import pandas as pd
import pytest

from dispatchgrid import catalog
from tests.conftest import DATA


def test_every_scenario_of_the_month(spark):
    e = pd.read_parquet(f"{DATA}/events.parquet")
    hours = (pd.to_datetime(e.ts) - pd.Timestamp("2024-01-01")) / pd.Timedelta(hours=1)
    times, km = defaultdict(list), defaultdict(float)
    for h, user in zip(hours, e.user_id, strict=True):
        s, block = int(h // 6), user % 25
        times[s].append(h - 6 * s)
        km[s] += math.dist((block % 5, block // 5), (2, 2))
    wait = {}
    for s, arrivals in times.items():
        free, wait[s] = [0.0, 0.0], 0.0
        for t in sorted(arrivals):
            begin = max(t, heapq.heappop(free))
            heapq.heappush(free, begin + 0.03)
            wait[s] += begin - t
    queue = catalog.queries()["i2_fleet_queue"](spark, DATA).collect()
    assert {r["s"]: r["n"] for r in queue} == {s: len(t) for s, t in times.items()} and max(times) > 100
    assert {r["s"]: r["total_wait"] for r in queue} == pytest.approx(wait, abs=2e-6)
    shared = catalog.queries()["i3_shared_arrivals"](spark, DATA).collect()
    assert {r["s"]: r["n"] for r in shared} == {s: len(t) for s, t in times.items()}
    assert {r["s"]: r["km"] for r in shared} == pytest.approx(km, abs=2e-6)
