"""Vehicles sent out in waves: capacitated routes, the cost of a wave by its vehicles, and a fleet's plan over a horizon.

A wave is a row of the region's size (its active blocks with their demand); waves and vehicle numbers are rows that tasks
solve by themselves. What is planned over the horizon is one small table, a row per number of vehicles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import SPEED_KMH
from dispatchgrid.operators.routing import length, two_opt
from dispatchgrid.operators.scenarios import scenario_demand
from dispatchgrid.plans.region import Region

EXACT = 9
INTERVAL_H = 0.5
CAPACITY = 8


def subset_tours(d: np.ndarray) -> tuple[np.ndarray, dict]:
    """Shortest closed tour from place 0 over every set of the other places, and the last place of each with its path."""
    n = len(d) - 1
    best = np.full((1 << n, n), np.inf)
    came = np.zeros((1 << n, n), np.int64)
    for j in range(n):
        best[1 << j, j] = d[0, j + 1]
    for mask in range(1, 1 << n):
        inside = [j for j in range(n) if mask >> j & 1]
        for j in (j for j in range(n) if not mask >> j & 1):
            ways = best[mask, inside] + d[np.array(inside) + 1, j + 1]
            k = int(ways.argmin())
            if ways[k] < best[mask | 1 << j, j]:
                best[mask | 1 << j, j], came[mask | 1 << j, j] = ways[k], inside[k]
    total = best + d[1:, 0][None, :]
    total[0] = 0
    return total.min(axis=1), {"best": total, "came": came}


def _order(mask: int, known: dict) -> list[int]:
    out, j = [], int(known["best"][mask].argmin())
    while mask:
        out.append(j + 1)
        mask, j = mask & ~(1 << j), int(known["came"][mask, j])
    return out[::-1]


def exact_routes(d: np.ndarray, q: np.ndarray, vehicles: int, capacity: float) -> list[list[int]] | None:
    """The shortest set of at most `vehicles` routes from place 0 within capacity, or None where there is none."""
    n = len(d) - 1
    tours, known = subset_tours(d)
    load = np.array([sum(q[j + 1] for j in range(n) if m >> j & 1) for m in range(1 << n)])
    tours = np.where(load <= capacity, tours, np.inf)

    @lru_cache(maxsize=None)
    def cover(mask: int, left: int) -> tuple[float, tuple[int, ...]]:
        if not mask:
            return 0.0, ()
        if not left:
            return math.inf, ()
        low, best = mask & -mask, (math.inf, ())
        rest = mask ^ low
        sub = rest
        while True:
            own = sub | low
            if tours[own] < best[0]:
                cost, parts = cover(mask ^ own, left - 1)
                best = min(best, (tours[own] + cost, (own, *parts)))
            if not sub:
                return best
            sub = (sub - 1) & rest

    cost, parts = cover((1 << n) - 1, vehicles)
    return None if math.isinf(cost) else [_order(m, known) for m in parts]


def joined_routes(d: np.ndarray, q: np.ndarray, vehicles: int, capacity: float) -> list[list[int]]:
    """Routes joined end to end where that saves most, within capacity; beyond it only while there are too many; then 2-opt."""
    routes = [[j] for j in range(1, len(d))]
    while True:
        best = None
        for a in range(len(routes)):
            for b in range(a + 1, len(routes)):
                over = max(0.0, float(q[routes[a]].sum() + q[routes[b]].sum()) - capacity)
                if over and len(routes) <= vehicles:
                    continue
                for x in (routes[a], routes[a][::-1]):
                    for y in (routes[b], routes[b][::-1]):
                        key = (over, round(d[x[-1], y[0]] - d[x[-1], 0] - d[0, y[0]], 9), a, b)
                        if best is None or key < best[0]:
                            best = key, x + y
        if best is None or (len(routes) <= vehicles and best[0][1] >= -1e-12):
            break
        (_, _, a, b), joined = best
        routes = [r for i, r in enumerate(routes) if i not in (a, b)] + [joined]
    out = []
    for r in routes:
        at = [0, *r]
        tour = two_opt(d[np.ix_(at, at)], list(range(len(at))))
        out.append([at[i] for i in tour[1:]])
    return out


def routes(d: np.ndarray, q: np.ndarray, vehicles: int, capacity: float) -> list[list[int]]:
    """Round trips where there is a vehicle for each place, the exact plan up to EXACT places, joined routes beyond; the
    shorter way round of each is the one that delivers sooner."""
    n = len(d) - 1
    if vehicles >= n:
        return [[j] for j in range(1, n + 1)]
    plan = (exact_routes(d, q, vehicles, capacity) if n <= EXACT else None) or joined_routes(d, q, vehicles, capacity)
    return [min((r, r[::-1]), key=lambda r: (round(delivery(d, q, r), 9), r)) for r in plan]


def delivery(d: np.ndarray, q: np.ndarray, r: list[int]) -> float:
    """Hours from the depot to each rider's place, summed over riders."""
    legs = d[[0, *r[:-1]], r]
    return float((np.cumsum(legs) / SPEED_KMH * q[r]).sum())


def truncated(q: np.ndarray, most: float) -> np.ndarray:
    """Places that stay, largest demand first, until the capacity is passed; the one that passes it stays too."""
    order = np.argsort(-q, kind="stable")
    before = np.cumsum(q[order]) - q[order]
    return np.sort(order[before <= most]) if q.sum() > most else np.arange(len(q))


def wave(x: np.ndarray, y: np.ndarray, q: np.ndarray, vehicles: int, capacity: float = CAPACITY, depot: tuple[float, float] = (2.0, 2.0)) -> dict:
    """One wave with some vehicles: km, hours to the riders, riders served and dropped, and the longest tour."""
    if vehicles == 0 or not len(q):
        return {"km": 0.0, "arrival_h": 0.0, "served": 0, "dropped": int(q.sum()), "longest_h": 0.0}
    keep = truncated(q, vehicles * capacity)
    px, py, load = np.append(depot[0], x[keep]), np.append(depot[1], y[keep]), np.append(0.0, q[keep])
    d = np.hypot(px[:, None] - px, py[:, None] - py)
    plan = routes(d, load, vehicles, capacity)
    tours = [length(d, [0, *r]) for r in plan]
    return {"km": sum(tours), "arrival_h": sum(delivery(d, load, r) for r in plan), "served": int(load.sum()), "dropped": int(q.sum() - load.sum()), "longest_h": max(tours) / SPEED_KMH}


def waves(r: Region) -> DataFrame:
    """s, demand: the active blocks of each scenario with their places and riders."""
    q = scenario_demand(r).where("q > 0").join(F.broadcast(r.blocks()), "block")
    return q.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("block", "x_km", "y_km", "q"))).alias("demand"))


_WAVE = "s long, vehicles int, km double, arrival_h double, served long, dropped long, longest_h double"


def wave_costs(demand: DataFrame, most: int, capacity: float = CAPACITY) -> DataFrame:
    """Every wave with every number of vehicles up to `most`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, demand, k in zip(f["s"], f["demand"], f["vehicles"], strict=True):
                get = lambda c, demand=demand: np.array([float(z[c]) for z in demand])
                rows.append({"s": s, "vehicles": k, **wave(get("x_km"), get("y_km"), get("q"), int(k), capacity)})
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _WAVE.split(", ")])

    each = demand.withColumn("vehicles", F.explode(F.sequence(F.lit(0), F.lit(most))))
    return each.repartition("s", "vehicles").mapInPandas(run, _WAVE)


def wave_table(costs: DataFrame, interval_h: float = INTERVAL_H) -> DataFrame:
    """By vehicles: riders' hours of a wave, km, and how many waves its vehicles are away; riders left behind wait two intervals."""
    hours = F.avg("served") * interval_h / 2 + F.avg("arrival_h") + F.avg("dropped") * 2 * interval_h
    away = F.greatest(F.lit(1), F.ceil(F.round(F.avg("longest_h") / interval_h, 9)).cast("int"))
    return costs.groupBy("vehicles").agg(hours.alias("hours"), F.avg("km").alias("km"), F.avg("served").alias("served"), F.avg("arrival_h").alias("arrival_h"), away.alias("away"))


def fleet_plan(table: list[tuple[int, float, int]], fleet: int, horizon: int) -> tuple[float, list[int]]:
    """The vehicles of each wave of the horizon that cost riders the fewest hours while no more than `fleet` are out: over
    states of how many come back after 1, 2, ... waves. table: (vehicles, hours, waves away)."""
    longest = max(a for _, _, a in table)
    states = {(0,) * (longest - 1): (0.0, ())}
    for _ in range(horizon):
        nxt: dict[tuple[int, ...], tuple[float, tuple[int, ...]]] = {}
        for out, (cost, plan) in states.items():
            for k, hours, away in table:
                if k + sum(out) <= fleet:
                    later = tuple(n + (k if i < away - 1 else 0) * (i == away - 2) for i, n in enumerate((*out[1:], 0)[: longest - 1]))
                    new = round(cost + hours, 9), (*plan, k)
                    if later not in nxt or new < nxt[later]:
                        nxt[later] = new
        states = nxt
    cost, plan = min(states.values())
    return cost / horizon, list(plan)


@query("l14_exact_routes")
def l14(spark, sf_dir):
    """Exact capacitated routes of each scenario and district."""
    r = Region(spark, sf_dir)
    q = scenario_demand(r).where("q > 0").join(F.broadcast(r.blocks()), "block")
    groups = q.groupBy("s", "district").agg(F.array_sort(F.collect_list(F.struct("block", "x_km", "y_km", "q"))).alias("demand"))
    costs = wave_costs(groups.select((F.col("s") * 10 + F.col("district")).alias("s"), "demand"), 2, 4).where("vehicles = 2")
    return costs.select(F.floor(F.col("s") / 10).alias("s"), (F.col("s") % 10).cast("int").alias("district"), "served", "dropped", F.round("km", 6).alias("km"))


@query("l15_joined_routes")
def l15(spark, sf_dir):
    """Routes of each scenario over the whole region by one to four vehicles."""
    c = wave_costs(waves(Region(spark, sf_dir)), 4).where("vehicles > 0")
    return c.select("s", "vehicles", "served", "dropped", F.round("km", 6).alias("km"), F.round("longest_h", 6).alias("longest_h"))


def _plans(r: Region, most: int = 4, horizon: int = 8, fleets: int = 8) -> DataFrame:
    """fleet, hours, plan: the best plan of each fleet size; the wave table has a row per number of vehicles."""
    table = wave_table(wave_costs(waves(r), most)).agg(F.array_sort(F.collect_list(F.struct("vehicles", "hours", "away"))).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for m, t in zip(f["fleet"], f["t"], strict=True):
                cost, plan = fleet_plan([(x["vehicles"], x["hours"], x["away"]) for x in t], int(m), horizon)
                out.append((m, cost, ",".join(map(str, plan))))
            yield pd.DataFrame(out, columns=["fleet", "hours", "plan"])

    return r.spark.range(1, fleets + 1).withColumnRenamed("id", "fleet").crossJoin(F.broadcast(table)).mapInPandas(run, "fleet long, hours double, plan string")


@query("l17_fleet_plan")
def l17(spark, sf_dir):
    """Riders' hours a wave and the vehicles sent in each, by fleet size."""
    return _plans(Region(spark, sf_dir)).select("fleet", F.round("hours", 6).alias("hours"), "plan")


@query("o13_temporal_only")
def o13(spark, sf_dir):
    """Waves every half hour by a fixed number of vehicles, the whole region one district: hours a rider, km an hour and costs."""
    c = wave_costs(waves(Region(spark, sf_dir)), 4).where("vehicles > 0")
    riders = F.greatest(F.sum("served"), F.lit(1))
    km = F.avg("km") / INTERVAL_H
    out = c.groupBy("vehicles").agg(F.lit(INTERVAL_H / 2).alias("wait_h"), (F.sum("arrival_h") / riders).alias("ride_h"), km.alias("km_per_h"), F.sum("dropped").alias("dropped"), (km + 4.0 * F.first("vehicles")).alias("provider_cost"))
    return out.select("vehicles", "dropped", *(F.round(x, 6).alias(x) for x in ("wait_h", "ride_h", "km_per_h", "provider_cost")))


@query("s27_wave_samples")
def s27(spark, sf_dir):
    """The routes' size of each scenario's wave with two vehicles, after truncation."""
    c = wave_costs(waves(Region(spark, sf_dir)), 2, 4).where("vehicles = 2")
    return c.select("s", "served", "dropped", F.round("km", 6).alias("km"))
