"""Partitions of the region into districts: restarts with swaps of centres, and cuts on the dearest district's cost.

The region is one row of arrays (N blocks, N x N distances; N is bounded by MOST_BLOCKS, which is checked). Restarts are rows
that are dealt over tasks, each refined by itself; what comes back is a row per block of the best one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions import exprs as E
from dispatchgrid.operators.evaluate import ARRIVALS, TERMS_SQL, WR, _terms, newton_sql
from dispatchgrid.operators.robust import root_mass_worst_case
from dispatchgrid.plans.region import ODD_WEIGHTS, Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)
MOST_BLOCKS = 2500


def best_interval(fixed: float, alpha: float, wr: float, wv: float) -> float:
    """The T = c*c that is cheapest for fixed/c^2 + alpha/c + (wr/wv) alpha c + wr c^2 on c in [0.01, 20]: the slope rises with c."""
    lo, hi = 0.01, 20.0
    for _ in range(80):
        c = (lo + hi) / 2
        rising = -2 * fixed / c**3 - alpha / c**2 + (wr / wv) * alpha + 2 * wr * c > 0
        lo, hi = (lo, c) if rising else (c, hi)
    return ((lo + hi) / 2) ** 2


@dataclass
class Problem:
    """The region and the prices of a design."""

    ids: np.ndarray
    km: np.ndarray
    p: np.ndarray
    area: np.ndarray
    omega: np.ndarray
    near: list[list[int]]
    radius: float = 0.0
    arrivals: float = ARRIVALS
    wr: float = WR
    wv: float = 1.0
    fixed_interval: float | None = None
    known: dict = field(default_factory=dict)

    def tour(self, members: tuple[int, ...]) -> tuple[float, np.ndarray]:
        """The worst tour coefficient of a district within the radius, and the roots of the masses that give it."""
        if members not in self.known:
            w = np.zeros(len(self.ids))
            w[list(members)] = np.sqrt(self.area[list(members)])
            value, mass, _ = root_mass_worst_case(self.p, self.km, w, self.radius, 120)
            self.known[members] = value, np.sqrt(np.maximum(mass, 0))
        return self.known[members]

    def district(self, members: tuple[int, ...], linehaul: float, odd: float | None = None) -> dict:
        """Cost a rider and hour of a district at its best interval, its slopes by tour, linehaul and difficulty, and the interval."""
        m = list(members)
        odd = float(np.maximum(self.omega[m].max(axis=0), 0) @ np.array(ODD_WEIGHTS)) if odd is None else odd
        alpha = E.TOUR_CONSTANT * self.arrivals**0.5 * self.tour(members)[0]
        t = best_interval(linehaul + odd, alpha, self.wr, self.wv) if self.fixed_interval is None else self.fixed_interval
        c = t**0.5
        cost = (linehaul + odd) / t + alpha / c + self.wr / (2 * self.wv) * linehaul + self.wr / self.wv * alpha * c + self.wr * t
        return {"cost": cost, "T": t, "linehaul": linehaul, "odd": odd, "alpha": alpha, "by_alpha": 1 / c + self.wr / self.wv * c, "by_linehaul": 1 / t + self.wr / (2 * self.wv), "by_odd": 1 / t}

    def settle(self, centers: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[int, ...]]]:
        """Blocks to their nearest centre and centres to their one-medians, in turn, until the centres stay or come again."""
        seen = set()
        while True:
            groups = self.deal(centers)
            medians = tuple(sorted(m[int(np.round(self.km[np.ix_(m, m)].sum(axis=0), 9).argmin())] for m in map(list, groups)))
            if medians == tuple(sorted(centers)) or medians in seen:
                return tuple(sorted(centers)), groups
            seen.add(medians)
            centers = medians

    def deal(self, centers: tuple[int, ...]) -> list[tuple[int, ...]]:
        centers = sorted(centers)
        to = np.round(self.km[:, centers], 9).argmin(axis=1)
        return [tuple(np.flatnonzero(to == k).tolist()) for k in range(len(centers))]

    def depot(self, groups: list[tuple[int, ...]]) -> int:
        """The block from which the nearest blocks of the districts, weighted by their demand, are least far."""
        total = sum(self.p[list(m)].sum() * self.km[:, list(m)].min(axis=1) for m in groups)
        return int(np.round(total, 9).argmin())

    def value(self, groups: list[tuple[int, ...]], depot: int | None = None) -> tuple[float, int, list[dict]]:
        """The dearest district's cost, the depot and all districts."""
        depot = self.depot(groups) if depot is None else depot
        rows = [self.district(m, float(self.km[depot, list(m)].min())) for m in groups]
        return max(r["cost"] for r in rows), depot, rows

    def improve(self, centers: tuple[int, ...], groups: list[tuple[int, ...]]) -> tuple[tuple[int, ...], list[tuple[int, ...]], float]:
        """Swaps of a centre for a neighbour, the first that pays each time, until none does."""
        best = self.value(groups)[0]
        moved = True
        while moved:
            moved = False
            for c, n in ((c, n) for c in centers for n in self.near[c] if n not in centers):
                swapped = tuple(sorted({*centers, n} - {c}))
                dealt = self.deal(swapped)
                cost = self.value(dealt)[0]
                if cost < best - 1e-12:
                    centers, groups, best, moved = swapped, dealt, cost, True
                    break
        return centers, groups, best

    def restart(self, k: int, seed: int) -> tuple[float, tuple[int, ...], list[tuple[int, ...]]]:
        """One restart: centres drawn by hash, settled, then improved."""
        drawn = sorted(range(len(self.ids)), key=lambda i: hashlib.md5(f"{seed}:{self.ids[i]}".encode()).digest())[:k]
        centers, groups, cost = self.improve(*self.settle(tuple(drawn)))
        return cost, centers, groups


def one_row(r: Region) -> DataFrame:
    """The region as one row of arrays in the order of its blocks."""
    n = r.blocks().count()
    if n > MOST_BLOCKS:
        raise ValueError(f"{n} blocks; one task holds at most {MOST_BLOCKS}")
    b = r.blocks().join(r.demand(), "block", "left").join(r.odd(), "block", "left").fillna(0.0, ["p", "omega1", "omega2"])
    rows = b.agg(F.array_sort(F.collect_list(F.struct("block", "p", "area_km2", "omega1", "omega2"))).alias("b"))
    km = r.distances().agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "km"))), lambda x: x["km"]).alias("km"))
    edges = r.edges().agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    return rows.crossJoin(km).crossJoin(edges)


def problem(row, **prices) -> Problem:
    b = row["b"]
    ids = np.array([x["block"] for x in b])
    place = {int(i): k for k, i in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    for x in row["e"]:
        near[place[x["src"]]].append(place[x["dst"]])
    get = lambda c: np.array([float(x[c]) for x in b])
    return Problem(ids, np.array(row["km"], float).reshape(len(ids), -1), get("p"), get("area_km2"), np.stack([get("omega1"), get("omega2")], axis=1), near, **prices)


_RESTART = "restart long, cost double, depot long, block long, root long, T double"


def restarts(r: Region, k: int, n: int, **prices) -> DataFrame:
    """restart, cost, depot, block, root, T: the partition of each restart; roots are the blocks nearest to the depot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                x = problem(row, **prices)
                _, _, groups = x.restart(k, int(row["id"]))
                cost, depot, rows = x.value(groups)
                out = []
                for m, d in zip(groups, rows, strict=True):
                    root = min(m, key=lambda j: (round(x.km[depot, j], 9), j))
                    out += [(int(row["id"]), round(cost, 9), int(x.ids[depot]), int(x.ids[j]), int(x.ids[root]), d["T"]) for j in m]
                yield pd.DataFrame(out, columns=["restart", "cost", "depot", "block", "root", "T"])

    spark = r.spark
    return spark.range(0, n, 1, min(n, spark.sparkContext.defaultParallelism)).crossJoin(F.broadcast(one_row(r))).mapInPandas(run, _RESTART)


def best_partition(r: Region, k: int = 5, n: int = 12, **prices) -> DataFrame:
    every = restarts(r, k, n, **prices)
    best = every.groupBy().agg(F.min_by("restart", F.struct("cost", "restart")).alias("restart"))
    return every.join(F.broadcast(best), "restart")


def _shown(d: DataFrame) -> DataFrame:
    return d.select("block", "root", "depot", R6("cost", "cost"), R6("T", "T"))


@query("l6_partition_search")
def l6_search(spark, sf_dir):
    """Best of twelve restarts with centre swaps and depot choice."""
    return _shown(best_partition(Region(spark, sf_dir)))


@query("o11_joint_nominal")
def o11(spark, sf_dir):
    """Districts and intervals together for the demand as it is, on the region's blocks."""
    return _shown(best_partition(Region(spark, sf_dir), 5, 8))


@query("o11_joint_robust")
def o11_robust(spark, sf_dir):
    """The same for the worst demand within half a kilometre."""
    return _shown(best_partition(Region(spark, sf_dir), 5, 4, radius=0.5))


@query("o10_spatial_only_search")
def o10_search(spark, sf_dir):
    """Districts alone: one interval of a quarter of an hour for all."""
    return _shown(best_partition(Region(spark, sf_dir), 5, 8, fixed_interval=0.25))


_CUT = f"""with terms as (select * from ({TERMS_SQL.split("with terms as (", 1)[1].rsplit(")", 1)[0]})), t as (select *, sqrt({newton_sql("(linehaul_km + odd_cost)", "alpha", str(ARRIVALS), str(WR))}) as c from terms)
select t.district, block, round((1 / c + {WR} * c) * {E.TOUR_CONSTANT} * sqrt({ARRIVALS}) * sqrt(coalesce(p, 0)) * sqrt(area_km2), 6) as by_member, round(1 / (c * c) + {WR} / 2, 6) as by_linehaul, round(1 / (c * c), 6) as by_odd from t, blocks left join demand using (block)"""


@query("l4_cut_coefficients", sql(_CUT, "blocks", "demand", "odd", "dist", "depot"))
def l4(spark, sf_dir):
    """Slopes of each district's cost by the membership of every block, by linehaul and by difficulty, at the demand as it is."""
    r = Region(spark, sf_dir)
    t = _terms(spark, sf_dir).withColumn("c", F.sqrt(E.dispatch_interval(F.col("linehaul_km") + F.col("odd_cost"), F.col("alpha"), F.lit(ARRIVALS), F.lit(WR))))
    blocks = r.blocks().join(r.demand(), "block", "left").select("block", F.sqrt(F.coalesce("p", F.lit(0.0))).alias("x"), F.sqrt("area_km2").alias("side"))
    c = F.col("c")
    by_member = (1 / c + WR * c) * E.TOUR_CONSTANT * ARRIVALS**0.5 * F.col("x") * F.col("side")
    return t.select("district", "c").crossJoin(blocks).select("district", "block", R6(by_member, "by_member"), R6(1 / (c * c) + WR / 2, "by_linehaul"), R6(1 / (c * c), "by_odd"))


def contiguous(members: tuple[int, ...], near: list[list[int]]) -> bool:
    inside, seen, todo = set(members), {members[0]}, [members[0]]
    while todo:
        for n in near[todo.pop()]:
            if n in inside and n not in seen:
                seen.add(n)
                todo.append(n)
    return len(seen) == len(inside)


def two_districts(x: Problem) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """All ways to part the blocks into two contiguous districts."""
    n, out = len(x.ids), []
    for size in range(1, n):
        for rest in itertools.combinations(range(1, n), size):
            one = tuple(i for i in range(n) if i not in rest)
            if contiguous(one, x.near) and contiguous(rest, x.near):
                out.append((one, rest))
    return out


def cut_loop(x: Problem, iterations: int = 5000, tolerance: float = 1e-2) -> tuple[list[tuple[int, float, float]], float, tuple]:
    """(iteration, bound, best cost), the best cost and its two (members, root, depot).

    The master takes, of all contiguous pairs with all roots and depots, the one whose dearer district is bounded lowest. A
    district costs no less than one with some of its blocks and no longer linehaul (twice the way from depot to root), so
    what one is found to cost bounds all that hold it: the cuts. A linear cut from the slopes would not do, since the cost
    is concave in tour, linehaul and difficulty and lies below it. So the bound holds, and the loop ends at the optimum.
    """
    n = len(x.ids)
    pairs = two_districts(x)
    options = [(m, root, depot) for m in sorted({m for pair in pairs for m in pair}) for root in m for depot in range(n)]
    place = {o: i for i, o in enumerate(options)}
    member = np.zeros((len(options), n))
    for i, (m, _, _) in enumerate(options):
        member[i, list(m)] = 1
    linehaul = 2 * x.km[[o[1] for o in options], [o[2] for o in options]]
    under = np.zeros(len(options))
    cells = np.array([(place[a, i, d], place[b, j, d]) for a, b in pairs for d in range(n) for i in a for j in b])

    def cut(m: tuple[int, ...], way: float) -> float:
        nonlocal under
        cost = x.district(m, way)["cost"]
        inside = np.zeros(n)
        inside[list(m)] = 1
        under = np.where((member @ inside == len(m)) & (linehaul >= way - 1e-9), np.maximum(under, cost), under)
        return cost

    for i, j in itertools.combinations_with_replacement(range(n), 2):
        cut(tuple(sorted({i, j})), 0.0)
    history, best, found = [], np.inf, None
    for it in range(1, iterations + 1):
        worst = under[cells].max(axis=1)
        pick = cells[int(worst.argmin())]
        bound = float(worst.min())
        cost = max(cut(options[k][0], float(linehaul[k])) for k in pick)
        if cost < best:
            best, found = cost, tuple(options[k] for k in pick)
        history.append((it, bound, best))
        if best - bound <= tolerance:
            break
    return history, best, found


def exact_pair(x: Problem) -> float:
    """The least cost of the dearest district over all contiguous pairs, roots and depots."""
    cost = {}
    for pair in two_districts(x):
        for m in pair:
            if m not in cost:
                cost[m] = np.array([min(x.district(m, 2 * float(x.km[r, d]))["cost"] for r in m) for d in range(len(x.ids))])
    return float(min(np.maximum(cost[a], cost[b]).min() for a, b in two_districts(x)))


def corner(x: Problem, side: int = 3) -> Problem:
    """The blocks of the grid's first `side` columns and rows."""
    keep = [i for i, b in enumerate(x.ids) if b % 5 < side and b // 5 < side]
    new = {i: k for k, i in enumerate(keep)}
    p = x.p[keep] / x.p[keep].sum()
    return Problem(x.ids[keep], x.km[np.ix_(keep, keep)], p, x.area[keep], x.omega[keep], [[new[n] for n in x.near[i] if n in new] for i in keep], x.radius, 25.0, x.wr, 10.0)


@query("l5_cut_history")
def l5(spark, sf_dir):
    """Bound and best cost by iteration for two districts of a 3 by 3 region, and the least cost there is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                x = corner(problem(row))
                least = exact_pair(x)
                yield pd.DataFrame([(i, round(b, 6), round(u, 6), round(u - b, 6), round(least, 6)) for i, b, u in cut_loop(x)[0]], columns=["iteration", "bound", "best", "gap", "least"])

    return one_row(Region(spark, sf_dir)).mapInPandas(run, "iteration long, bound double, best double, gap double, least double")
