"""Studies over radii, sample sizes and tours, reports of lines, and maps of the region; each point of a study is a row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import SPEED_KMH, TOUR_CONSTANT, distance
from dispatchgrid.functions.ordered import Ordered
from dispatchgrid.operators.helpers import legs
from dispatchgrid.operators.on_demand import simulated
from dispatchgrid.operators.partition import Problem, best_partition, corner, one_row, problem
from dispatchgrid.operators.robust import root_mass_worst_case, worst_mean, worst_sql
from dispatchgrid.operators.routing import TOUR_SQL, cells_sql, nearest_neighbour, per_group, per_places, spanning_tree, tour_length, tours_sql
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


def solved(rows: DataFrame, f, schema: str) -> DataFrame:
    """f of each row with the region beside it; f gives a list of tuples."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                yield pd.DataFrame(f(row), columns=names)

    return rows.mapInPandas(run, schema)


def points(spark, name: str, values: list) -> DataFrame:
    """One row and task for each value."""
    return spark.range(0, len(values), 1, len(values)).select(F.get(F.array(*map(F.lit, values)), F.col("id").cast("int")).alias(name))


def all_mass(x: Problem, radius: float) -> tuple[float, np.ndarray, float]:
    return root_mass_worst_case(x.p, x.km, np.sqrt(x.area), radius, 600)


@query("s15_worst_mass")
def s15(spark, sf_dir):
    """The demand within half a kilometre that makes the region's tour longest, as shares."""

    def f(row):
        x = problem(row)
        _, mass, _ = all_mass(x, 0.5)
        share = mass / mass.sum() if mass.sum() > 1e-10 else np.full(len(mass), 1 / len(mass))
        return [(int(i), round(float(m), 3)) for i, m in zip(x.ids, share, strict=True)]

    return solved(one_row(Region(spark, sf_dir)), f, "block long, share double")


@query("s11_bound_gap_by_radius")
def s11(spark, sf_dir):
    """Lower and upper bounds of the worst tour by the radius: its own coefficient, and the root of mass times area."""

    def f(row):
        x = problem(row)
        value, _, gap = all_mass(x, float(row["radius"]))
        upper = math.sqrt(x.p.sum() * x.area.sum())
        return [(row["radius"], round(value, 3), round(upper, 6), round(upper / value, 3), bool(gap < 1e-2))]

    r = Region(spark, sf_dir)
    return solved(points(spark, "radius", [0.0, 0.25, 0.5, 1.0, 2.0, 4.0]).crossJoin(F.broadcast(one_row(r))), f, "radius double, lower double, upper double, ratio double, certified boolean")


@query("o22_sample_size_study")
def o22(spark, sf_dir):
    """Samples of the demand by size: the radius that shrinks with their root, the worst tour about the sample, and whether it
    covers the tour of the demand itself."""

    def f(row):
        x, n = problem(row), int(row["n"])
        u = np.array([(i * 0.6180339887498949 + 0.37) % 1.0 for i in range(n)])
        sample = np.bincount(np.searchsorted(np.cumsum(x.p), u * x.p.sum(), "right").clip(0, len(x.p) - 1), minlength=len(x.p)) / n
        radius = 2.0 / math.sqrt(n)
        about = Problem(x.ids, x.km, sample, x.area, x.omega, x.near)
        value, _, _ = all_mass(about, radius)
        true = float(np.sqrt(x.area) @ np.sqrt(x.p))
        return [(n, round(radius, 6), round(float(np.sqrt(x.area) @ np.sqrt(sample)), 6), round(value, 2), round(true, 6), value >= true - 0.05)]

    r = Region(spark, sf_dir)
    return solved(points(spark, "n", [10, 30, 100, 300, 1000]).crossJoin(F.broadcast(one_row(r))), f, "n long, radius double, nominal double, worst double, true double, covered boolean")


@query("l21_moment_problem")
def l21(spark, sf_dir):
    """The worst tour with unequal weights by the primal, and the dual at its multipliers above it: the gap certifies both."""

    def f(row):
        x = problem(row)
        out = []
        for radius in (0.1, 0.5, 1.0):
            w = np.sqrt(x.area) * (1 + 0.1 * (x.ids % 5))
            value, mass, gap = root_mass_worst_case(x.p, x.km, w, radius, 1500)
            price = w / (2 * np.sqrt(np.maximum(mass, 1e-12)))
            lam = np.concatenate([[0.0], np.linspace(0, 4, 400)])
            dual = min(l * radius + float(x.p @ (price[None, :] - l * x.km).max(axis=1)) + float((w * w / (4 * price)).sum()) for l in lam)
            out.append((radius, round(value, 2), round(dual, 2), bool(dual >= value - 1e-6), bool(gap < 0.05)))
        return out

    return solved(one_row(Region(spark, sf_dir)), f, "radius double, primal double, dual double, above boolean, certified boolean")


def best_pair(x: Problem) -> tuple[float, tuple[int, ...], int]:
    """The least cost of the dearer of two districts, one of them, and how many parts of plans were looked at: blocks go to one
    or the other in turn, and what a part costs already bounds all that come of it."""
    n, depot = len(x.ids), 0
    cost = lambda m: x.district(m, float(x.km[depot, list(m)].min()))["cost"] if m else 0.0
    floor = lambda m: x.district(m, 0.0)["cost"] if m else 0.0  # noqa: E731  # a longer district may come nearer to the depot
    best, found, looked = math.inf, (), 0
    todo: list[tuple[tuple[int, ...], tuple[int, ...]]] = [((0,), ())]
    while todo:
        a, b = todo.pop()
        looked += 1
        if max(floor(a), floor(b)) >= best - 1e-12:
            continue
        k = len(a) + len(b)
        if k == n:
            value = max(cost(a), cost(b))
            if b and value < best - 1e-12:
                best, found = value, a
            continue
        todo += [(a, (*b, k)), ((*a, k), b)] if sum(x.p[list(a)]) < sum(x.p[list(b)]) else [((*a, k), b), (a, (*b, k))]
    return best, found, looked


@query("l22_branch_and_bound")
def l22(spark, sf_dir):
    """Two districts of the 3 by 3 corner by branching with bounds."""

    def f(row):
        best, one, looked = best_pair(corner(problem(row)))
        return [(round(best, 6), ",".join(map(str, one)), looked < 2**9)]

    return solved(one_row(Region(spark, sf_dir)), f, "cost double, members string, pruned boolean")


def embedded(d: np.ndarray) -> tuple[np.ndarray, float]:
    """Places in the plane whose distances come nearest to d by its two largest eigenvalues, signs fixed, and the stress."""
    n = len(d)
    j = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    at = vector[:, -2:][:, ::-1] * np.sqrt(np.maximum(value[-2:][::-1], 0))
    at *= np.where(at[np.abs(at).argmax(axis=0), [0, 1]] < 0, -1, 1)
    e = np.hypot(*(at[:, None, k] - at[None, :, k] for k in (0, 1)))
    return at, float(np.sqrt(((e - d) ** 2).sum() / max((d * d).sum(), 1e-12)))


@query("k4_map_of_distances")
def k4(spark, sf_dir):
    """Places that fit the distances along the edges, and how far off they are in all."""

    def f(row):
        x = problem(row)
        rows = x.ids // 5
        at, stress = embedded(np.abs(x.ids[:, None] % 5 - x.ids[None, :] % 5) + np.abs(rows[:, None] - rows[None, :]).astype(float))
        return [(int(i), round(float(np.hypot(*p)), 6), round(stress, 6)) for i, p in zip(x.ids, at, strict=True)]

    return solved(one_row(Region(spark, sf_dir)), f, "block long, from_middle double, stress double")


_SIZES = "select n * 1000000 + stop // n as g, row_number() over (partition by n, stop // n order by stop) as k, x_km as x, y_km as y from stops, (select unnest(range(3, 11)) as n)"


_CONSTANT = f""", t as (select n, exact_km as km from ex join m using (g) where n > 2),
y as (select n, i * 20 / 99.0::double as y, avg(abs(km - {TOUR_CONSTANT} * sqrt((n + i * 20 / 99.0::double) * 25))) as error from t, range(100) r(i) group by n, i),
e as (select n, round(arg_min(y, (round(error, 9), y)), 6) as shift, round(min(error), 6) as error from y group by n)
select n, count(*)::bigint as tours, round(avg(km / sqrt(n * 25.0::double)), 6) as ratio, round(stddev_pop(km / sqrt(n * 25.0::double)), 6) as spread, any_value(shift) as shift, any_value(error) as error,
round(avg(km / sqrt(n) - {TOUR_CONSTANT} * 5), 6) as offset_km from t join e using (n) group by n"""


@query("p3_tour_constant", sql(tours_sql(_SIZES, _CONSTANT, "ex"), "stops", recursive=True))
def p3(spark, sf_dir):
    """Tours of three to ten stops each by their number: mean length over the root of number and area, the addition to the number
    with which the root estimates them best (of a hundred from 0 to 20), and what a tour has beyond the root, by the root."""
    s = Region(spark, sf_dir).stops().withColumn("size", F.explode(F.array(*map(F.lit, range(3, 11)))))
    s = s.select((F.col("size").cast("long") * 1000000 + F.floor(F.col("stop") / F.col("size"))).alias("g"), "stop", "x_km", "y_km")
    t = per_group(s, "g", "stop", lambda d: {"n": len(d), "km": tour_length(d)}, "n long, km double").where("n > 2")
    y = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("y", F.col("i") * 20 / F.lit(99.0))
    y = y.groupBy("n", "y").agg(F.avg(F.abs(F.col("km") - TOUR_CONSTANT * F.sqrt((F.col("n") + F.col("y")) * 25))).alias("error"))
    y = y.groupBy("n").agg(R6(F.min_by("y", F.struct(F.round("error", 9), "y")), "shift"), R6(F.min("error"), "error"))
    ratio = F.col("km") / F.sqrt(F.col("n") * 25)
    each = t.groupBy("n").agg(F.count("*").alias("tours"), R6(F.avg(ratio), "ratio"), R6(F.stddev_pop(ratio), "spread"), R6(F.avg(F.col("km") / F.sqrt("n") - TOUR_CONSTANT * 5), "offset_km"))
    return each.join(y, "n")


_DEPOT = "select g, row_number() over (partition by g order by stop) as k, x, y from (select (stop % 12)::int as g, stop, x_km as x, y_km as y from stops union all select distinct (stop % 12)::int, 0, 2.5::double, 2.5::double from stops)"


@query("m4_depot_tours", sql(tours_sql(_DEPOT, f"select g as cell, n, {TOUR_SQL} as tour_km, round({TOUR_CONSTANT} * sqrt(n * 25.0::double), 6) as estimate_km, round(2 * tree_km, 6) as tree_km from nnt join best using (g) left join ex using (g) join tree using (g)", "best", "ex", "tree"), "stops", recursive=True))
def m4(spark, sf_dir):
    """A tour from the depot through each group's stops: exact or improved, the estimate from their number, and twice the tree."""
    stops = Region(spark, sf_dir).stops().select((F.col("stop") % 12).cast("int").alias("cell"), "stop", "x_km", "y_km")
    depot = stops.select("cell").distinct().select("cell", F.lit(0).cast("long").alias("stop"), F.lit(2.5).alias("x_km"), F.lit(2.5).alias("y_km"))
    f = lambda d, n: {"n": n, "tour_km": round(tour_length(d, n), 6), "estimate_km": round(TOUR_CONSTANT * math.sqrt(n * 25.0), 6), "tree_km": round(2 * spanning_tree(d), 6)}
    return per_places(stops.select("cell", F.col("stop").cast("long").alias("stop"), "x_km", "y_km").union(depot), "cell", "stop", f, "n long, tour_km double, estimate_km double, tree_km double")


_PARTS = "select route * 100000 + (seq - 1) // 4 as g, row_number() over (partition by route, (seq - 1) // 4 order by seq) as k, x_km as x, y_km as y from stops"


@query("m7_order_in_subpath", sql(tours_sql(_PARTS, "select g as part, array_to_string(list_transform(t, lambda i: i - 1), ',') as places, round(way, 6) as km from nnt", "nnt"), "stops", recursive=True))
def m7(spark, sf_dir):
    """Stops between every fourth checkpoint of a route in the order of the nearest next, and the way through them."""
    s = Region(spark, sf_dir).stops().select((F.col("route") * 100000 + F.floor((F.col("seq") - 1) / 4)).alias("part"), "seq", "x_km", "y_km")

    def f(d):
        order = nearest_neighbour(d)
        return {"places": ",".join(map(str, order)), "km": round(float(sum(d[a, b] for a, b in zip(order, order[1:], strict=False))), 6)}

    return per_group(s, "part", "seq", f, "places string, km double")


@query("s19_tour_lengths", sql(tours_sql(cells_sql(8), f"select g as cell, n, {TOUR_SQL} as km from nnt join best using (g) left join ex using (g)", "best", "ex"), "stops", recursive=True))
def s19(spark, sf_dir):
    return per_places(Region(spark, sf_dir).stops().withColumn("cell", (F.col("stop") % 8).cast("int")), "cell", "stop", lambda d, n: {"n": n, "km": round(tour_length(d, n), 6)}, "n long, km double")


@query("s10_assign_and_recentre", sql("with a as (select src as block, arg_min(dst, (round(km, 9), dst)) as centre from dist where dst in (6, 8, 16, 18) group by src), s as (select a.centre, a.block, sum(d.km) as total from a join a b on a.centre = b.centre join dist d on d.src = a.block and d.dst = b.block group by a.centre, a.block) select centre, arg_min(block, (round(total, 9), block)) as recentred, round(min(total), 6) as km from s group by centre", "dist"))
def s10(spark, sf_dir):
    """Blocks to the nearest of four centres, then each centre to its members' one-median."""
    d = Region(spark, sf_dir).distances()
    a = d.where(F.col("dst").isin(6, 8, 16, 18)).groupBy(F.col("src").alias("block")).agg(F.min_by("dst", F.struct(F.round("km", 9), "dst")).alias("centre"))
    pair = a.select(F.col("block").alias("src"), "centre").join(a.select(F.col("block").alias("dst"), "centre"), "centre").join(d, ["src", "dst"])
    s = pair.groupBy("centre", "src").agg(F.sum("km").alias("total"))
    return s.groupBy("centre").agg(F.min_by("src", F.struct(F.round("total", 9), "src")).alias("recentred"), R6(F.min("total"), "km"))


@query("s16_design_pair")
def s16(spark, sf_dir):
    """The designs without and with the worst case, side by side."""
    r = Region(spark, sf_dir)
    pair = [best_partition(r, 4, 2, radius=radius).select(F.lit(name).alias("design"), "block", "root", R6("T", "T")) for name, radius in (("nominal", 0.0), ("robust", 0.5))]
    return pair[0].unionByName(pair[1])


_ARROWS = """with n as (select d.src, arg_min(dst, (round(km, 9), dst)) as dst, min(km) as km from dist d join blocks b on b.block = dst and b.x_km = 0 group by d.src),
c as (select src, dst, km, p, sum(p * km) over (order by round(km, 9), src rows between unbounded preceding and 1 preceding) as before from n join demand on block = src where km > 0)
select src::bigint as src, dst::bigint as dst, round(least(p, greatest(0.5 - coalesce(before, 0), 0) / km), 6) as mass, a.x_km as ax, a.y_km as ay, b.x_km as bx, b.y_km as by from c join blocks a on a.block = src join blocks b on b.block = dst
where p > 0 and coalesce(before, 0) < 0.5"""


@query("s25_transport_arrows", sql(_ARROWS, "blocks", "demand", "dist"))
def s25(spark, sf_dir):
    """Where the worst case for one district, the first column of blocks, moves demand: pairs of places with the mass between them.

    A district gains most when the nearest demand outside moves to its nearest block first, until the radius is used up: a
    running total of the work, in the order of the way."""
    r = Region(spark, sf_dir)
    b = r.blocks()
    there = r.distances().join(b.where("x_km = 0").select(F.col("block").alias("dst")), "dst")
    near = there.groupBy("src").agg(F.min_by("dst", F.struct(F.round("km", 9), "dst")).alias("dst"), F.min("km").alias("km")).where("km > 0")
    moves = near.join(r.demand().where("p > 0").select(F.col("block").alias("src"), "p"), "src").withColumn("way", F.round("km", 9))
    moves = Ordered(moves, "way", "src").running(upto=F.col("p") * F.col("km")).withColumn("left", 0.5 - (F.col("upto") - F.col("p") * F.col("km")))
    at = lambda c, n: b.select(F.col("block").alias(c), F.col("x_km").alias(f"{n}x"), F.col("y_km").alias(f"{n}y"))
    moved = moves.where("left > 0").select("src", "dst", R6(F.least(F.col("p"), F.col("left") / F.col("km")), "mass"))
    return moved.join(at("src", "a"), "src").join(at("dst", "b"), "dst").withColumns({c: F.col(c).cast("bigint") for c in ("src", "dst")})


@query("o7_line_report", sql("""with n as (select block, arg_min(struct_pack(route := route, stop := stop), (round(sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2), 9), route, seq)) as pick, min(sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2)) as km from blocks b, stops s group by block),
c as (select route, sum(secs) / 3600.0 as cycle from stops group by route)
select n.pick.route as route, count(*)::bigint as blocks, round(sum(coalesce(p, 0) * km / 5) / greatest(sum(coalesce(p, 0)), 1e-12), 6) as walk_h, round(max(km / 5), 6) as worst_walk_h, round(any_value(cycle) / 2, 6) as wait_h, round(any_value(cycle), 6) as cycle_h from n left join demand using (block) join c on c.route = n.pick.route group by n.pick.route""", "blocks", "stops", "demand"))
def o7(spark, sf_dir):
    """For each line: blocks that walk to it, their mean and longest walk, and the wait for one vehicle that goes round it."""
    from dispatchgrid.operators.nearest import nearest

    r = Region(spark, sf_dir)
    near = nearest(r.blocks(), r.stops().withColumn("rank", F.struct("route", "seq", "x_km", "y_km")), "block", "rank").select("block", "pick.*")
    walk = near.select("block", "route", F.col("x_km").alias("sx"), F.col("y_km").alias("sy")).join(r.blocks().select("block", "x_km", "y_km"), "block").join(r.demand(), "block", "left")
    hours, p = distance(F.col("x_km"), F.col("y_km"), F.col("sx"), F.col("sy")) / 5, F.coalesce("p", F.lit(0.0))
    g = walk.groupBy("route").agg(F.count("*").alias("blocks"), R6(F.sum(p * hours) / F.greatest(F.sum(p), F.lit(1e-12)), "walk_h"), R6(F.max(hours), "worst_walk_h"))
    cycle = r.stops().groupBy("route").agg((F.sum("secs") / 3600.0).alias("cycle"))
    return g.join(cycle, "route").select("route", "blocks", "walk_h", "worst_walk_h", R6(F.col("cycle") / 2, "wait_h"), R6("cycle", "cycle_h"))


_WALKS = "select b.block, min(sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2)) / 5 as v from blocks b, stops s group by b.block"


@query("o7_worst_walk_report", worst_sql(_WALKS, "stops").replace(" as worst from (", " as worst_walk_h, (select round(sum(p * v), 6) from v join demand using (block)) as walk_h from ("))
def o7_worst(spark, sf_dir):
    """The mean walk to the lines at the demand as it is and at the worst within half a kilometre."""
    from dispatchgrid.operators.nearest import nearest

    r = Region(spark, sf_dir)
    near = nearest(r.blocks(), r.stops().withColumn("rank", F.struct("route", "seq", "x_km", "y_km")), "block", "rank").select("block", F.col("pick.x_km").alias("sx"), F.col("pick.y_km").alias("sy"))
    v = near.join(r.blocks(), "block").select("block", (distance(F.col("x_km"), F.col("y_km"), F.col("sx"), F.col("sy")) / 5).alias("v"))
    mean = v.join(r.demand(), "block").agg(R6(F.sum(F.col("p") * F.col("v")), "walk_h"))
    return mean.crossJoin(worst_mean(v, r.demand(), r.distances(), 0.5).select(R6("worst", "worst_walk_h")))


def evaluated(r: Region, mode: str) -> DataFrame:
    """Costs of the region's districts as fixed lines or as tours; ValueError for another mode."""
    if mode == "tour":
        return simulated(r, r.blocks().select("block", F.col("district").cast("long").alias("root")), 0.5)
    if mode == "fixed":
        km = legs(r).groupBy("route").agg(F.sum(distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("km"))
        return km.agg(R6(F.sum("km") / 0.5, "travel_cost"), R6(F.sum("km") / (SPEED_KMH * 0.5), "fleet"))
    raise ValueError(f"mode {mode!r} is neither fixed nor tour")


@query("o6_evaluate_by_mode")
def o6(spark, sf_dir):
    r = Region(spark, sf_dir)
    both = [evaluated(r, m).select(F.lit(m).alias("mode"), "travel_cost", "fleet") for m in ("fixed", "tour")]
    return both[0].unionByName(both[1])


def exponential_fit(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """a, b, c of a * exp(b * x) + c: for a given b the best a and c follow by least squares, and b is sought by steps that
    halve where neither way is better."""

    def best(b: float) -> tuple[float, float, float]:
        m = np.stack([np.exp(b * (x - x.max())), np.ones(len(x))], axis=1)
        (a, c), *_ = np.linalg.lstsq(m, y, rcond=None)
        return float(a), float(c), float(((m @ (a, c) - y) ** 2).sum())

    span = float(x.max() - x.min()) or 1.0
    grid = np.concatenate([-np.geomspace(20, 0.01, 40), np.geomspace(0.01, 20, 40)]) / span
    b = float(min(grid, key=lambda b: best(b)[2]))
    step = abs(b) / 4
    for _ in range(rounds):
        b, moved = min((b - step, b, b + step), key=lambda z: best(z)[2] if z else np.inf), b
        step = step if b != moved else step / 2
    a, c, _ = best(b)
    return a * float(np.exp(-b * x.max())), b, c


@query("p9_exponential_fit")
def p9_exponential(spark, sf_dir):
    """The curve a * exp(b * x) + c through mean prices by quantity."""
    g = Region(spark, sf_dir).table("lineitem").groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("y"))
    row = g.agg(F.array_sort(F.collect_list(F.struct(F.col("l_quantity").cast("double").alias("x"), "y"))).alias("p"))  # fifty quantities

    def f(row):
        a, b, c = exponential_fit(np.array([z["x"] for z in row["p"]]), np.array([z["y"] for z in row["p"]]))
        return [(round(a, 2), round(b, 4), round(c, 2))]

    return solved(row, f, "a double, b double, c double")
