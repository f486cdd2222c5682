"""Worst cases over a Wasserstein ball of demand distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)
RADIUS, SECTIONS = 0.5, 65


def worst_mean(values: DataFrame, demand: DataFrame, dist: DataFrame, radius: float) -> DataFrame:
    """The largest mean of values over distributions within radius km of demand, by its dual in one multiplier.

    The dual radius * m + sum_j p_j max_l (v_l - m d_jl) is convex and piecewise linear in m >= 0. Each round takes it at
    SECTIONS multipliers in one aggregation over the pairs of blocks and keeps the stretch about the least, until the
    stretch is too short to tell. values: block, v; demand: block, p; dist: src, dst, km.
    """
    spark = values.sparkSession
    lines = demand.join(dist, F.col("block") == F.col("src")).select("src", "p", "dst", "km").join(values.select(F.col("block").alias("dst"), "v"), "dst")
    per = lines.groupBy("src", "p").agg(F.collect_list(F.struct("km", "v")).alias("to"))
    top = lines.agg((F.max("v") - F.min("v")).alias("v"), F.min(F.when(F.col("km") > 0, F.col("km"))).alias("km")).first()
    lo, hi, least = 0.0, (top["v"] or 0.0) / (top["km"] or 1.0) + 1e-9, None
    while True:
        grid = [lo + (hi - lo) * i / (SECTIONS - 1) for i in range(SECTIONS)]
        at = per.select("p", "to", F.explode(F.array(*map(F.lit, grid))).alias("m"))
        best = at.groupBy("m").agg(F.sum(F.col("p") * F.array_max(F.transform("to", lambda t: t["v"] - F.col("m") * t["km"]))).alias("s"))
        found = sorted((r["m"], r["m"] * radius + r["s"]) for r in best.collect())  # SECTIONS rows
        i = min(range(len(found)), key=lambda i: found[i][1])
        least = found[i][1] if least is None else min(least, found[i][1])
        lo, hi = found[max(0, i - 1)][0], found[min(len(found) - 1, i + 1)][0]
        if hi - lo < 1e-10:
            return spark.range(1).select(F.lit(least).alias("worst"))


def worst_sql(values: str, *views: str) -> str:
    return sql(f"""with v as ({values}), ln as (select src, p, dst, km, v from demand d join dist on d.block = src join v on v.block = dst),
m as (select 0.0::double as m union select round((b.v - a.v) / (b.km - a.km), 12) from ln a join ln b on a.src = b.src where b.km > a.km and b.v > a.v),
c as (select m, src, any_value(p) * max(v - m * km) as c from m, ln group by m, src)
select round(min(b), 6) as worst from (select m * {RADIUS} + sum(c) as b from c group by m)""", "blocks", "demand", "dist", *views)


@query("l2_worst_district_mass", worst_sql("select block, (district = 0)::int::double as v from blocks"))
def l2(spark, sf_dir):
    r = Region(spark, sf_dir)
    return worst_mean(r.blocks().select("block", (F.col("district") == 0).cast("double").alias("v")), r.demand(), r.distances(), RADIUS).select(R6("worst", "worst"))


@query("l3_worst_walk", worst_sql("select block, 0.2 * (block % 7)::double as v from blocks"))
def l3(spark, sf_dir):
    r = Region(spark, sf_dir)
    return worst_mean(r.blocks().select("block", (0.2 * (F.col("block") % 7).cast("double")).alias("v")), r.demand(), r.distances(), RADIUS).select(R6("worst", "worst"))


def root_mass_worst_case(p: np.ndarray, d: np.ndarray, w: np.ndarray, radius: float, rounds: int = 4000) -> tuple[float, np.ndarray, float]:
    """Largest sum of w * sqrt(mass) over masses within radius of p, by Frank-Wolfe steps on the transport plan.

    Each step moves every source to its best target under a multiplier on distance that bisection sets so that the plan
    costs the radius; the gap certifies the value. radius 0 gives p itself.
    """
    n = len(p)
    plan = np.diag(p)
    if radius <= 0:
        return float(w @ np.sqrt(p)), p, 0.0
    gap = np.inf
    for _ in range(rounds):
        mass = plan.sum(axis=0)
        grad = w / (2 * np.sqrt(np.maximum(mass, 1e-14)))
        best = _linear(p, d, grad, radius, n)
        step = best - plan
        gap = float((step.sum(axis=0) * grad).sum())
        if gap < 1e-7:
            break
        lo, hi, move = 0.0, 1.0, step.sum(axis=0)
        for _ in range(50):
            mid = (lo + hi) / 2
            slope = (w * move / (2 * np.sqrt(np.maximum(mass + mid * move, 1e-14)))).sum()
            lo, hi = (mid, hi) if slope > 0 else (lo, mid)
        plan = plan + lo * step
    mass = plan.sum(axis=0)
    return float(w @ np.sqrt(np.maximum(mass, 0))), mass, gap


def _linear(p: np.ndarray, d: np.ndarray, g: np.ndarray, radius: float, n: int) -> np.ndarray:
    def at(m: float) -> tuple[np.ndarray, float]:
        to = np.argmax(g[None, :] - m * d, axis=1)
        return to, float(p @ d[np.arange(n), to])

    to, cost = at(0.0)
    if cost <= radius:
        plan = np.zeros((n, n))
        plan[np.arange(n), to] = p
        return plan
    lo, hi = 0.0, 1.0
    while at(hi)[1] > radius:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid)[1] > radius else (lo, mid)
    (a, ca), (b, cb) = at(lo), at(hi)
    t = 0.0 if ca == cb else (radius - cb) / (ca - cb)
    plan = np.zeros((n, n))
    np.add.at(plan, (np.arange(n), a), t * p)
    np.add.at(plan, (np.arange(n), b), (1 - t) * p)
    return plan


def worst_tour_coefficients(r: Region, radius: float) -> DataFrame:
    """district, alpha, gap: each district's worst tour coefficient; a task holds the region's matrix, whose size is checked."""
    from dispatchgrid.operators.partition import one_row, problem

    members = r.blocks().groupBy("district").agg(F.collect_set("block").alias("blocks"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                x = problem(row)
                w = np.sqrt(x.area) * np.isin(x.ids, list(row["blocks"]))
                value, _, gap = root_mass_worst_case(x.p, x.km, w, radius)
                out.append((row["district"], value, gap))
            yield pd.DataFrame(out, columns=["district", "alpha", "gap"])

    return members.crossJoin(F.broadcast(one_row(r))).repartition("district").mapInPandas(solve, "district int, alpha double, gap double")


@query("l1_worst_tour_zero_radius", sql("select district, round(sum(sqrt(coalesce(p, 0))), 6) as alpha from blocks left join demand using (block) group by district", "blocks", "demand"))
def l1_zero(spark, sf_dir):
    return worst_tour_coefficients(Region(spark, sf_dir), 0.0).select("district", R6("alpha", "alpha"))


@query("l1_worst_tour")
def l1(spark, sf_dir):
    t = worst_tour_coefficients(Region(spark, sf_dir), RADIUS)
    return t.select("district", F.round("alpha", 3).alias("alpha"), (F.col("gap") < 1e-2).alias("certified"))
