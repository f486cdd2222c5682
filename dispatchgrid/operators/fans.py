"""Districts of equal tour and ride load: lines and fans over a grid of the demand density.

The grid has a fixed number of cells whatever the data; it is one row, and the cuts follow one another in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import SPEED_KMH, TOUR_CONSTANT, distance
from dispatchgrid.operators.evaluate import ARRIVALS, WR
from dispatchgrid.operators.partition import best_interval
from dispatchgrid.plans.region import Region

RES, ANGLES, CENTERS, BINS = 40, 360, 60, 120


def loads(r: Region, res: int = RES) -> DataFrame:
    """cell, x, y, block, tour, ride: root of the density and density times way from the depot, times the cell's area."""
    i, j, step = F.floor(F.col("id") / res), F.col("id") % res, 5.0 / res
    g = r.spark.range(res * res).select(F.col("id").alias("cell"), ((i + 0.5) * step - 0.5).alias("x"), ((j + 0.5) * step - 0.5).alias("y"))
    b = r.blocks().join(r.demand(), "block", "left").select("block", (F.coalesce("p", F.lit(0.0)) / F.col("area_km2")).alias("f"), F.col("x_km").cast("bigint").alias("cx"), F.col("y_km").cast("bigint").alias("cy"))
    g = g.withColumn("cx", F.floor(F.col("x") + 0.5)).withColumn("cy", F.floor(F.col("y") + 0.5)).join(F.broadcast(b), ["cx", "cy"])
    area = step * step
    return g.select("cell", "x", "y", "block", (F.sqrt("f") * area).alias("tour"), (2 * distance(F.col("x"), F.col("y"), F.lit(2.0), F.lit(2.0)) * F.col("f") * area).alias("ride"))


def line_split(x: np.ndarray, y: np.ndarray, tour: np.ndarray, ride: np.ndarray, share: float, angles: int = ANGLES) -> np.ndarray:
    """Cells on the one side of the line that takes `share` of the tour load and comes nearest to it in ride load."""
    turn = np.arange(angles) * (2 * math.pi / angles)
    along = np.round(np.outer(np.cos(turn), x) + np.outer(np.sin(turn), y), 9)
    order = np.argsort(-along, axis=1, kind="stable")
    upto = np.cumsum(tour[order], axis=1)
    n = np.minimum((upto < share * tour.sum() - 1e-12).sum(axis=1) + 1, len(x) - 1)
    got = np.cumsum(ride[order], axis=1)[np.arange(angles), n - 1]
    k = int(np.round(np.abs(got - share * ride.sum()), 12).argmin())
    side = np.zeros(len(x), bool)
    side[order[k, : n[k]]] = True
    return side


def fan_split(x: np.ndarray, y: np.ndarray, tour: np.ndarray, ride: np.ndarray, shares: tuple[float, float, float]) -> np.ndarray:
    """0, 1 or 2 for each cell: three sectors, none wider than half a turn, about a centre from which one ray points down.

    Of all centres and pairs of rays the one whose sectors' loads are off their shares the least; thirds by x where a sector
    stays empty.
    """
    best, out = math.inf, None
    goal = np.array(shares)
    rays = np.arange(1, BINS)
    a, b = np.meshgrid(rays, rays, indexing="ij")
    half = BINS // 2
    ok = (a <= half) & (b > a) & (b - a <= half) & (BINS - b <= half)
    for c in range(0, len(x), max(1, len(x) // CENTERS)):
        turn = np.mod(np.arctan2(x - x[c], y[c] - y), 2 * math.pi)
        at = np.minimum((turn / (2 * math.pi / BINS)).astype(int), BINS - 1)
        off = np.zeros(a.shape)
        for load in (tour, ride):
            upto = np.concatenate([[0.0], np.cumsum(np.bincount(at, load, BINS))]) / max(float(load.sum()), 1e-12)
            off += np.abs(upto[a] - goal[0]) + np.abs(upto[b] - upto[a] - goal[2]) + np.abs(1 - upto[b] - goal[1])
        off = np.where(ok, off, math.inf)
        if off.min() < best - 1e-12:
            best = float(off.min())
            k = np.unravel_index(off.argmin(), off.shape)
            out = np.where(at < a[k], 0, np.where(at >= b[k], 1, 2))
    if out is None or len(set(out.tolist())) < 3:
        out = np.zeros(len(x), int)
        for k, part in enumerate(np.array_split(np.argsort(x, kind="stable"), 3)):
            out[part] = k
    return out


def decomposition(x: np.ndarray, tour: np.ndarray, ride: np.ndarray, m: int) -> tuple[int, ...]:
    """Into how many districts each part is to fall: two parts whose slivers of tour load have ride loads off to the same
    side (the most even such pair), else three, else halves."""
    order = np.argsort(x, kind="stable")
    upto, rides = np.cumsum(tour[order]), np.cumsum(ride[order])
    sign = [0] * (m + 1)
    for i in range(1, m):
        n = int(np.searchsorted(upto, i / m * tour.sum() - 1e-12))
        off = rides[min(n, len(x) - 1)] - i / m * ride.sum()
        sign[i] = int(np.sign(np.round(off, 12)))
    pairs = [(abs(m - 2 * i), i, m - i) for i in range(1, m // 2 + 1) if sign[i] == sign[m - i] or 0 in (sign[i], sign[m - i])]
    if pairs:
        return min(pairs)[1:]
    threes = [(max(i, j, m - i - j), i, j, m - i - j) for i in range(1, m) for j in range(i, m - i) if m - i - j >= j and sign[i] == sign[j] == sign[m - i - j]]
    return min(threes)[1:] if threes else (m // 2, m - m // 2)


def divide(x: np.ndarray, y: np.ndarray, tour: np.ndarray, ride: np.ndarray, m: int) -> np.ndarray:
    """District 0 to m - 1 of each cell, by cuts within cuts."""
    out = np.zeros(len(x), int)
    todo = [(np.arange(len(x)), m, 0)]
    while todo:
        cells, k, first = todo.pop()
        if k == 1 or len(cells) <= 1:
            out[cells] = first
            continue
        own = (x[cells], y[cells], tour[cells], ride[cells])
        parts = decomposition(own[0], own[2], own[3], k)
        side = np.where(line_split(*own, parts[0] / k), 0, 1) if len(parts) == 2 else fan_split(*own, tuple(p / k for p in parts))
        for i, p in enumerate(parts):
            todo.append((cells[side == i], p, first + sum(parts[:i])))
    return out


def districts(cells: DataFrame, m: int) -> DataFrame:
    """cell, district."""
    row = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "x", "y", "tour", "ride"))).alias("c"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["c"]:
                get = lambda name, c=c: np.array([z[name] for z in c])
                yield pd.DataFrame({"cell": get("cell"), "district": divide(get("x"), get("y"), get("tour"), get("ride"), m)})

    return row.mapInPandas(run, "cell long, district int")


@query("k14_three_fan")
def k14(spark, sf_dir):
    """Shares of both loads in three sectors of a third each."""
    cells = loads(Region(spark, sf_dir))
    row = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "x", "y", "tour", "ride"))).alias("c"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["c"]:
                get = lambda name, c=c: np.array([z[name] for z in c])
                yield pd.DataFrame({"cell": get("cell"), "sector": fan_split(get("x"), get("y"), get("tour"), get("ride"), (1 / 3, 1 / 3, 1 / 3))})

    s = row.mapInPandas(run, "cell long, sector int").join(cells, "cell").groupBy("sector").agg(F.count("*").alias("n"), F.sum("tour").alias("tour"), F.sum("ride").alias("ride"))
    whole = cells.agg(F.sum("tour").alias("t"), F.sum("ride").alias("r"))
    return s.crossJoin(F.broadcast(whole)).select("sector", "n", F.round(F.col("tour") / F.col("t"), 6).alias("tour_share"), F.round(F.col("ride") / F.col("r"), 6).alias("ride_share"))


@query("k15_recursive_partition")
def k15(spark, sf_dir):
    return districts(loads(Region(spark, sf_dir)), 5)


@query("o12_equal_load")
def o12(spark, sf_dir):
    """Five districts of equal load: tour coefficient, way from the depot, best interval, and what a rider waits and rides."""
    cells = loads(Region(spark, sf_dir))
    d = districts(cells, 5).join(cells, "cell").groupBy("district").agg(F.count("*").alias("n"), F.sum("tour").alias("alpha"), F.min(distance(F.col("x"), F.col("y"), F.lit(2.0), F.lit(2.0))).alias("linehaul_km"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["T"] = [best_interval(2 * k, TOUR_CONSTANT * ARRIVALS**0.5 * a, WR, SPEED_KMH) for k, a in zip(f["linehaul_km"], f["alpha"], strict=True)]
            yield f

    d = d.mapInPandas(run, "district int, n long, alpha double, linehaul_km double, T double")
    tour = TOUR_CONSTANT * F.sqrt(F.lit(ARRIVALS) * F.col("T")) * F.col("alpha")
    km = 2 * F.col("linehaul_km") + tour
    return d.select("district", "n", *(F.round(c, 6).alias(n) for c, n in ((F.col("alpha"), "alpha"), (F.col("linehaul_km"), "linehaul_km"), (F.col("T"), "T"), (km / F.col("T"), "km_per_h"), (F.col("T") / 2, "wait_h"), ((F.col("linehaul_km") + tour / 2) / SPEED_KMH, "ride_h"))))
