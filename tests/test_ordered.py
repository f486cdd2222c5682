"""Running totals, next values, chains and packing in order, over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from dispatchgrid.functions.ordered import Ordered, chain, packed_in_order


@pytest.fixture(params=[4, 17])
def many(spark, request):
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", held[0])
    spark.conf.set("spark.sql.adaptive.enabled", held[1])


def rows(n=400):
    rng = random.Random(1)
    return [(i, rng.choice([None, 1, 1, 2, 5]), rng.choice([None, None, None, rng.randint(0, 99)])) for i in range(n)]


def test_running(many):
    own = Ordered(many.createDataFrame(rows(), "i long, k long, v long"), "k", "i").running(total=F.col("v"), n=F.lit(1))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = {r["i"]: (r["total"], r["n"]) for r in own.collect()}
    total, want = 0, {}
    for n, (i, _, v) in enumerate(sorted(rows(), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        total += v or 0
        want[i] = (total, n + 1)
    assert got == want


@pytest.mark.parametrize("itself", [True, False])
def test_next_seen(many, itself):
    got = {r["i"]: r["then"] for r in Ordered(many.createDataFrame(rows(), "i long, k long, v long"), "k", "i").next_seen("then", F.col("v"), itself).collect()}
    order = sorted(rows(), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: next((x[2] for x in order[n + (not itself) :] if x[2] is not None), None) for n, r in enumerate(order)}


def test_chain(spark):
    rng = random.Random(4)
    to = {i: rng.randint(i + 1, i + 4) if i < 190 else None for i in range(200)}
    got = {r["node"]: r["rank"] for r in chain(spark.createDataFrame(list(to.items()), "node long, to long"), 3).collect()}
    want, at = {}, 3
    while at is not None:
        want[at], at = len(want), to.get(at)
    assert got == want


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_packing(many, most):
    rng = random.Random(6)
    sizes = [(i, rng.randint(1, 9)) for i in range(150)]
    got = {r["i"]: r["vehicle"] for r in packed_in_order(many.createDataFrame(sizes, "i long, q long"), "q", most, "i").collect()}
    vehicle, load, want = 0, most + 1, {}
    for i, q in sizes:
        if load + q > most:
            vehicle, load = vehicle + 1, 0
        load += q
        want[i] = vehicle
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "i long, q long")
    assert Ordered(none, "i").running(s=F.col("q")).count() == 0
    assert packed_in_order(none, "q", 5, "i").count() == 0
