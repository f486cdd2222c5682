"""Rides alone by a fleet with a queue, the evaluator by simulated tours, and sweeps of the methods."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import SPEED_KMH, distance, fleet_sizes, hash_uniform
from dispatchgrid.operators.evaluate import ARRIVALS
from dispatchgrid.operators.routing import length, nearest_neighbour
from dispatchgrid.operators.scenarios import poisson_quantile, riders
from dispatchgrid.plans.methods import sweep
from dispatchgrid.plans.region import Region

HORIZON_H, SCENARIOS, MOST_FLEET = 1.0, 8, 40


def requests(r: Region, arrivals: float, horizon: float = HORIZON_H, n: int = SCENARIOS) -> DataFrame:
    """s, t, service: when riders come and how long a vehicle is away with each; all fleets see the same."""
    s = r.spark.range(n).withColumnRenamed("id", "s")
    mean = F.coalesce("p", F.lit(0.0)) * arrivals * horizon
    q = r.blocks().join(r.demand(), "block").crossJoin(F.broadcast(s)).withColumn("q", poisson_quantile(mean, hash_uniform(F.col("s") * 100 + F.col("block"), "od"))).where("q > 0")
    each = q.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("q"))))
    key = (F.col("s") * 100 + F.col("block")) * 10000 + F.col("k")
    rad, ang = F.sqrt(hash_uniform(key, "odr")) * F.sqrt(F.col("area_km2") / math.pi), 2 * math.pi * hash_uniform(key, "oda")
    km = distance(F.col("x_km") + rad * F.cos(ang), F.col("y_km") + rad * F.sin(ang), F.lit(2.0), F.lit(2.0))
    return each.select("s", (horizon * hash_uniform(key, "odt")).alias("t"), km.alias("km"))


def queue(calls: Column, servers: Column) -> Column:
    """Total wait of calls (t, hours) in order, each served by the vehicle that is free first: a fold over the free times."""
    start = F.struct(F.transform(F.sequence(F.lit(1), servers), lambda _: F.lit(0.0)).alias("free"), F.lit(0.0).alias("wait"))

    def step(a: Column, c: Column) -> Column:
        begin = F.greatest(c["t"], F.array_min(a["free"]))
        at = F.array_position(a["free"], F.array_min(a["free"]))
        free = F.transform(a["free"], lambda x, i: F.when(i + 1 == at, begin + c["hours"]).otherwise(x))
        return F.struct(free.alias("free"), (a["wait"] + begin - c["t"]).alias("wait"))

    return F.aggregate(calls, start, step)["wait"]


def fleet_costs(r: Region, arrivals: float, wr: float, fleet_rate: float = 4.0, fleets: tuple[int, ...] = (4, 8, 12, 16, 20, 24, 28, 32, 36, 40)) -> DataFrame:
    """fleet, km_per_h, wait_h, ride_h, provider_cost, total_cost by fleet size."""
    c = requests(r, arrivals).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", (2 * F.col("km") / SPEED_KMH).alias("hours")))).alias("calls"), F.sum("km").alias("km"), F.count("*").alias("n"))
    each = c.withColumn("fleet", F.explode(F.array(*map(F.lit, fleets)))).repartition("s", "fleet")
    q = each.select("s", "fleet", "km", "n", queue(F.col("calls"), F.col("fleet")).alias("wait"))
    g = q.groupBy("fleet").agg((F.sum("wait") / F.sum("n")).alias("wait_h"), (F.sum("km") / F.sum("n") / SPEED_KMH).alias("ride_h"), (2 * F.avg("km") / HORIZON_H).alias("km_per_h"))
    provider = F.col("km_per_h") + fleet_rate * F.col("fleet")
    return g.select("fleet", *(F.round(x, 6).alias(n) for x, n in ((F.col("km_per_h"), "km_per_h"), (F.col("wait_h"), "wait_h"), (F.col("ride_h"), "ride_h"), (provider, "provider_cost"), (provider + arrivals * wr * (F.col("wait_h") + F.col("ride_h")), "total_cost"))))


@query("o9_on_demand_queue")
def o9(spark, sf_dir):
    """What each fleet size costs when every rider is driven alone and waits for a free vehicle."""
    return fleet_costs(Region(spark, sf_dir), ARRIVALS, 1.0)


def simulated(r: Region, assignment: DataFrame, interval_h: float, fleet_rate: float = 4.0, wr: float = 1.0) -> DataFrame:
    """Costs of a design from tours through the riders that scenarios draw, not from the tour constant."""
    who = riders(r).join(assignment, "block").groupBy("s", "root").agg(F.array_sort(F.collect_list(F.struct("block", "k", "x", "y"))).alias("p"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for s, root, p in zip(f["s"], f["root"], f["p"], strict=True):
                at = np.array([(2.0, 2.0), *((q["x"], q["y"]) for q in p)])
                d = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
                tour = nearest_neighbour(d)
                upto = np.cumsum(d[tour[:-1], tour[1:]])
                out.append((s, root, len(p), d[0, 1:].min(), length(d, tour), float(upto.sum() / SPEED_KMH)))
            yield pd.DataFrame(out, columns=["s", "root", "n", "linehaul", "km", "ride"])

    t = who.mapInPandas(run, "s long, root long, n long, linehaul double, km double, ride double")
    by = t.groupBy("root").agg(F.avg("km").alias("km"), F.sum("n").alias("n"), F.sum("ride").alias("ride"), F.avg("linehaul").alias("linehaul"))
    amortised, whole = fleet_sizes(F.col("km"), F.lit(interval_h))
    g = by.select("*", amortised.alias("f"), whole.alias("w")).agg(F.sum("km").alias("km"), F.sum("linehaul").alias("linehaul"), F.sum("f").alias("fleet"), F.sum("w").alias("raw_fleet"), (F.sum("ride") / F.sum("n")).alias("ride_h"))
    provider = F.col("km") / interval_h + fleet_rate * F.col("raw_fleet")
    return g.select(*(F.round(x, 6).alias(n) for x, n in ((F.col("linehaul") / interval_h, "linehaul_cost"), (F.col("km") / interval_h, "travel_cost"), (F.col("fleet"), "fleet"), (F.col("raw_fleet"), "raw_fleet"), (F.lit(interval_h / 2), "wait_h"), (F.col("ride_h"), "ride_h"), (provider, "provider_cost"), (wr * (interval_h / 2 + F.col("ride_h")), "user_cost"))))


@query("o2_simulated_design")
def o2(spark, sf_dir):
    r = Region(spark, sf_dir)
    return simulated(r, r.blocks().select("block", F.col("district").cast("long").alias("root")), 0.5)


@query("o20_method_sweep")
def o20_sweep(spark, sf_dir):
    """Every registered method over some settings, and one that names no method, whose row says so."""
    modes = ("joint", "spatial_only", "strips", "on_demand")
    return sweep(Region(spark, sf_dir), [{"mode": m, "arrivals": a, "wr": 1} for m in modes for a in (50, 150)] + [{"mode": "teleport"}])


@query("o23_robust_study")
def o23(spark, sf_dir):
    """Designs for the demand as it is and for the worst within half a kilometre, both costed at the demand as it is."""
    return sweep(Region(spark, sf_dir), [{"mode": "joint"}, {"mode": "joint_robust"}]).select("mode", "status", "provider_cost", "wait_h", "ride_h", "user_cost", "total_cost")
