"""The method interface: registry, overrides, failures as rows, the order of costs, and the queue against a heap."""

import heapq

import pytest
from pyspark.sql import functions as F

from dispatchgrid.operators import on_demand
from dispatchgrid.plans import methods
from dispatchgrid.plans.region import Region
from tests.conftest import DATA


@pytest.fixture(scope="module")
def region(spark):
    return Region(spark, DATA)


@pytest.fixture(scope="module")
def rows(region):
    modes = ("joint", "spatial_only", "on_demand", "strips")
    return {r["mode"]: r for r in methods.sweep(region, [*({"mode": m} for m in modes), {"mode": "teleport"}, {}]).collect()}


def test_failures_are_rows(rows):
    assert rows["teleport"]["status"].startswith("failed") and rows["teleport"]["total_cost"] is None and rows[None]["status"].startswith("failed")
    assert all(rows[m]["status"] == "ok" for m in ("joint", "spatial_only", "on_demand", "strips"))
    with pytest.raises(ValueError):
        methods.make_method({"mode": "teleport"})


def test_provider_costs_rise_from_joint_over_fixed_intervals_to_rides_alone(rows):
    assert rows["joint"]["provider_cost"] < rows["spatial_only"]["provider_cost"] < rows["on_demand"]["provider_cost"]
    assert rows["on_demand"]["ride_h"] < rows["joint"]["ride_h"] and rows["spatial_only"]["wait_h"] == pytest.approx(0.125)


def test_overrides_go_before_estimates(region):
    d = methods.Strips().design(region, 150.0, 1.0)
    roots = [r["root"] for r in d.intervals.collect()]
    plain = methods.shared_evaluator(region, d, 150.0, 1.0).first()
    d.tour_override = region.spark.createDataFrame([(roots[0], 100.0)], "root long, km double")
    d.walk_h = 0.1
    tours = methods.shared_evaluator(region, d, 150.0, 1.0).first()
    assert tours["travel_cost"] > plain["travel_cost"] and tours["user_cost"] > plain["user_cost"] and tours["walk_h"] == 0.1
    fixed = methods.shared_evaluator(region, d, 150.0, 1.0, interval=2.0).first()
    assert fixed["wait_h"] == pytest.approx(1.0) and plain["wait_h"] == pytest.approx(0.25)
    free = methods.shared_evaluator(region, d, 150.0, 1.0, difficulty=methods.linear_difficulty(0.0, 0.0)).first()
    assert free["odd_cost"] == 0.0 < plain["odd_cost"]


def test_queue_equals_a_heap(spark, region):
    calls = on_demand.requests(region, 40.0, n=4).select("s", "t", (2 * F.col("km") / 30).alias("hours"))
    rows = calls.collect()
    grouped = calls.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "hours"))).alias("calls"))
    for servers in (1, 3, 7):
        got = {r["s"]: r["w"] for r in grouped.select("s", on_demand.queue(F.col("calls"), F.lit(servers)).alias("w")).collect()}
        for s in got:
            free, wait = [0.0] * servers, 0.0
            for t, hours in sorted((r["t"], r["hours"]) for r in rows if r["s"] == s):
                begin = max(t, heapq.heappop(free))
                heapq.heappush(free, begin + hours)
                wait += begin - t
            assert got[s] == pytest.approx(wait)
