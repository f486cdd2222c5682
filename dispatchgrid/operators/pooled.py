"""Pooled rides from the depot with agreed meeting points: riders walk a little so that vehicles drive straighter.

Requests are rows; a scenario is a group of its own, bounded by the arrivals of its horizon, and is planned in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import SPEED_KMH
from dispatchgrid.operators.scenarios import _requests
from dispatchgrid.plans.region import Region

WALK_KMH = 5.0
SWEEPS = 20


@dataclass(frozen=True)
class Rules:
    fleet: int = 4
    capacity: int = 4
    walk_km: float = 0.3
    horizon_h: float = 1.0
    wr: float = 1.0
    exact: int = 4  # batches of so many requests are planned over all insertions


def meeting_points(targets: np.ndarray, start: np.ndarray, walk_km: float) -> np.ndarray:
    """Stops in the order of targets, each within walk_km of its own: in turn moved towards the line between its neighbours
    (the depot beyond the ends) until none moves."""
    stops = targets.astype(float).copy()
    for _ in range(SWEEPS):
        before = stops.copy()
        for i, goal in enumerate(targets):
            a = stops[i - 1] if i else start
            b = stops[i + 1] if i + 1 < len(stops) else start
            along = b - a
            size = float(along @ along)
            foot = a if size < 1e-18 else a + min(1.0, max(0.0, float((goal - a) @ along) / size)) * along
            off = foot - goal
            far = float(np.hypot(*off))
            stops[i] = foot if far <= walk_km else goal + off * (walk_km / far)
        if np.abs(stops - before).max(initial=0.0) <= 1e-9:
            break
    return stops


@dataclass(frozen=True)
class Route:
    """Requests in order of their stops, with hours of waiting, walking and riding, and the km driven."""

    order: tuple[int, ...] = ()
    km: float = 0.0
    wait: float = 0.0
    walk: float = 0.0
    ride: float = 0.0

    def cost(self, wr: float) -> float:
        return self.km + wr * (self.wait + self.walk + self.ride)


class Batch:
    """The requests of a scenario: goals, release and deadline hours."""

    def __init__(self, goal: np.ndarray, release: np.ndarray, deadline: np.ndarray, start: np.ndarray, rules: Rules):
        self.goal, self.release, self.deadline, self.start, self.rules = goal, release, deadline, start, rules
        self.known: dict[tuple[int, ...], Route | None] = {(): Route()}

    def route(self, order: tuple[int, ...]) -> Route | None:
        """The route that serves requests in this order, or None if it is too full or too late for anyone."""
        if order not in self.known:
            self.known[order] = self._route(order) if len(order) <= self.rules.capacity else None
        return self.known[order]

    def _route(self, order: tuple[int, ...]) -> Route | None:
        own = list(order)
        stops = meeting_points(self.goal[own], self.start, self.rules.walk_km)
        legs = np.hypot(*np.diff(np.vstack([self.start, stops, self.start]), axis=0).T)
        leave = float(self.release[own].max())
        ride = np.cumsum(legs[:-1]) / SPEED_KMH
        walk = np.hypot(*(stops - self.goal[own]).T) / WALK_KMH
        if (leave + ride + walk > self.deadline[own] + 1e-9).any() or leave + legs.sum() / SPEED_KMH > self.rules.horizon_h + 1e-9:
            return None
        return Route(order, float(legs.sum()), float((leave - self.release[own]).sum()), float(walk.sum()), float(ride.sum()))

    def insertions(self, route: Route, i: int) -> Iterator[Route]:
        for at in range(len(route.order) + 1):
            new = self.route((*route.order[:at], i, *route.order[at:]))
            if new is not None:
                yield new

    def alone(self, i: int) -> Route:
        """A request that no route takes waits for the horizon's end and is driven by itself."""
        km = float(np.hypot(*(self.goal[i] - self.start)))
        return Route((i,), 2 * km, max(0.0, self.rules.horizon_h - float(self.release[i])), 0.0, km / SPEED_KMH)

    def plan(self) -> tuple[list[Route], list[int]]:
        """Routes and the requests left over: over all insertions for a small batch, by the least added cost beyond."""
        order = sorted(range(len(self.goal)), key=lambda i: (self.release[i], i))
        empty = [Route()] * self.rules.fleet
        return self._every(order, empty) if len(order) <= self.rules.exact else self._greedy(order, empty)

    def _places(self, routes: list[Route], i: int) -> Iterator[tuple[int, Route]]:
        """Ways to take a request; vehicles without any are all alike."""
        idle = next((v for v, r in enumerate(routes) if not r.order), None)
        for v, r in enumerate(routes):
            if r.order or v == idle:
                yield from ((v, new) for new in self.insertions(r, i))

    def _greedy(self, order: list[int], routes: list[Route]) -> tuple[list[Route], list[int]]:
        left = []
        for i in order:
            options = [(round(new.cost(self.rules.wr) - routes[v].cost(self.rules.wr), 9), k, v, new) for k, (v, new) in enumerate(self._places(routes, i))]
            if options:
                _, _, v, new = min(options, key=lambda o: o[:2])
                routes = [*routes[:v], new, *routes[v + 1 :]]
            else:
                left.append(i)
        return routes, left

    def _every(self, order: list[int], routes: list[Route]) -> tuple[list[Route], list[int]]:
        """Most requests served, then the least cost; a request is left over only where no place is open to it."""
        states = [(routes, [])]
        for i in order:
            states = [s for routes, left in states for s in ([([*routes[:v], new, *routes[v + 1 :]], left) for v, new in self._places(routes, i)] or [(routes, [*left, i])])]
        wr = self.rules.wr
        return min(states, key=lambda s: (len(s[1]), round(sum(r.cost(wr) for r in s[0]) + sum(self.alone(i).cost(wr) for i in s[1]), 9)))

    def metrics(self) -> dict:
        """Mean hours a request, km in all, and how many are left over; zeros where there are none."""
        n = len(self.goal)
        if not n:
            return {"n": 0, "overflow": 0, "wait_h": 0.0, "walk_h": 0.0, "ride_h": 0.0, "km": 0.0}
        routes, left = self.plan()
        every = [*routes, *map(self.alone, left)]
        mean = lambda name: sum(getattr(r, name) for r in every) / n
        return {"n": n, "overflow": len(left), "wait_h": mean("wait"), "walk_h": mean("walk"), "ride_h": mean("ride"), "km": sum(r.km for r in every)}


_STATS = "s long, n long, overflow long, wait_h double, walk_h double, ride_h double, km double"


def scenario_stats(requests: DataFrame, rules: Rules, depot: tuple[float, float] = (2.0, 2.0)) -> DataFrame:
    """Metrics of each scenario. requests: s, id, x, y, release_h, deadline_h."""
    rows = requests.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "release_h", "deadline_h"))).alias("q"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for s, q in zip(f["s"], f["q"], strict=True):
                get = lambda c, q=q: np.array([x[c] for x in q])
                b = Batch(np.stack([get("x"), get("y")], axis=1), get("release_h"), get("deadline_h"), np.array(depot), rules)
                out.append({"s": s, **b.metrics()})
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, _STATS)


def _batch(spark, sf_dir, horizon: float = 1.0) -> DataFrame:
    q = _requests(Region(spark, sf_dir)).where(F.col("release_h") < horizon)
    return q.select("s", (F.col("block") * 1000 + F.col("k")).alias("id"), "x", "y", "release_h", "deadline_h")


@query("l18_pooled_insertion")
def l18(spark, sf_dir):
    """Each scenario's requests put into routes by insertion, with stops agreed by l19's sweeps."""
    s = scenario_stats(_batch(spark, sf_dir), Rules(fleet=2, horizon_h=1.5))
    return s.select("s", "n", "overflow", *(F.round(c, 6).alias(c) for c in ("wait_h", "walk_h", "ride_h", "km")))


@query("o14_pooled_rides")
def o14(spark, sf_dir):
    """The mode over all scenarios: means of the scenarios' means, km an hour of horizon, and vehicles at their rate."""
    return pooled_costs(scenario_stats(_batch(spark, sf_dir), Rules(fleet=2, horizon_h=1.5)), Rules(fleet=2, horizon_h=1.5), 4.0)


def pooled_costs(stats: DataFrame, rules: Rules, fleet_rate: float) -> DataFrame:
    km = F.avg("km") / rules.horizon_h
    user = F.avg("wait_h") + F.avg("walk_h") + F.avg("ride_h")
    return stats.agg(
        F.round(F.avg("wait_h"), 6).alias("wait_h"), F.round(F.avg("walk_h"), 6).alias("walk_h"), F.round(F.avg("ride_h"), 6).alias("ride_h"), F.round(km, 6).alias("km_per_h"),
        F.lit(rules.fleet).alias("raw_fleet"), F.round(km / SPEED_KMH, 6).alias("fleet"), F.round(km + fleet_rate * rules.fleet, 6).alias("provider_cost"), F.round(rules.wr * user, 6).alias("user_cost"),
    )
