"""Tours and routes; each group is solved in its own task, over its places: points at one place are visited one after another,
so their number counts, and what a task holds and does grows with the places alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.plans.region import Region, sql

EXACT = 12


def _matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :])


class Plane:
    """Distances of places by their coordinates, looked up as in a matrix without being one."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, at):
        a, b = at if isinstance(at, tuple) else (at, slice(None))
        return np.hypot(self.x[a] - self.x[b], self.y[a] - self.y[b])


def nearest_neighbour(d: np.ndarray | Plane, start: int = 0) -> list[int]:
    """Order of visits, each time the nearest left; ties to the first."""
    left, tour = np.ones(len(d), bool), [start]
    left[start] = False
    for _ in range(len(d) - 1):
        row = np.where(left, d[tour[-1]], np.inf)
        near = np.flatnonzero(row <= row.min() + 2e-9)
        tour.append(min(near.tolist(), key=lambda j: (round(float(row[j]), 9), j)))
        left[tour[-1]] = False
    return tour


def length(d: np.ndarray, tour: list[int]) -> float:
    return float(sum(d[a, b] for a, b in zip(tour, tour[1:] + tour[:1], strict=True))) if len(tour) > 1 else 0.0


def two_opt(d: np.ndarray | Plane, tour: list[int], rounds: int = 100) -> list[int]:
    """First-improvement reversals until none shortens the tour: of each first end, all last ends still to come at once."""
    t = np.array(tour, int)
    n, legs = len(t), d[t, np.roll(t, -1)]  # from each place to the next
    for _ in range(rounds):
        better = False
        for i in range(1, n - 1):
            j = i + 1
            while j < n:
                a, b = t[i - 1], t[i]
                cut = d[a, t[j:]] + d[b, np.append(t[j + 1 :], t[0])] < legs[i - 1] + legs[j:] - 1e-12
                k = int(cut.argmax())
                if not cut[k]:
                    break
                j += k
                t[i : j + 1], legs[i:j] = t[i : j + 1][::-1].copy(), legs[i:j][::-1].copy()
                legs[i - 1], legs[j] = d[t[i - 1], t[i]], d[t[j], t[(j + 1) % n]]
                better, j = True, j + 1
        if not better:
            break
    return t.tolist()


def held_karp(d: np.ndarray) -> float:
    """Exact tour length by subsets."""
    n = len(d)
    if n < 3:
        return 2 * float(d[0, n - 1]) if n == 2 else 0.0
    best = {(1 << i, i): d[0, i] for i in range(1, n)}
    for size in range(2, n):
        new = {}
        for (seen, last), cost in best.items():
            for j in range(1, n):
                if not seen >> j & 1:
                    key, c = (seen | 1 << j, j), cost + d[last, j]
                    if c < new.get(key, np.inf):
                        new[key] = c
        best = new
    return float(min(c + d[last, 0] for (_, last), c in best.items()))


def spanning_tree(d: np.ndarray | Plane) -> float:
    """Length of a minimum spanning tree by Prim's rule."""
    if len(d) < 2:
        return 0.0
    near, total, left = np.array(d[0]), 0.0, np.ones(len(d), bool)
    left[0] = False
    while left.any():
        i = int(np.where(left, near, np.inf).argmin())
        total += near[i]
        left[i] = False
        near = np.minimum(near, d[i])
    return float(total)


def tour_length(d: np.ndarray | Plane, points: int | None = None) -> float:
    """Exact up to EXACT points (places where not given), beyond that nearest neighbour improved by reversals."""
    return held_karp(np.array([d[i] for i in range(len(d))])) if (points or len(d)) <= EXACT else length(d, two_opt(d, nearest_neighbour(d)))


def per_group(points: DataFrame, key: str, order: str, f: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """One row per group of points (x_km, y_km) from its distance matrix, in the order of a column."""
    kind = dict(points.dtypes)[key]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    groups = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "x_km", "y_km"))).alias("p"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            rows = [{key: k, **f(_matrix(np.array([q["x_km"] for q in p]), np.array([q["y_km"] for q in p])))} for k, p in zip(g[key], g["p"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return groups.mapInPandas(run, f"{key} {kind}, {schema}")


def per_places(points: DataFrame, key: str, order: str, f: Callable[[Plane, int], dict], schema: str) -> DataFrame:
    """One row per group of points (x_km, y_km) from its places, in the order of a column's least value at each, and the number of
    its points. Trees, the nearest next and reversals come out as over the points: the next of a place's points is at no
    distance, and a reversal that parts points of one place never shortens a tour."""
    kind = dict(points.dtypes)[key]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    places = points.groupBy(key, "x_km", "y_km").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    groups = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "x_km", "y_km"))).alias("p"), F.sum("n").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            rows = [{key: k, **f(Plane(np.array([q["x_km"] for q in p]), np.array([q["y_km"] for q in p])), int(n))} for k, p, n in zip(g[key], g["p"], g["n"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return groups.mapInPandas(run, f"{key} {kind}, {schema}")


#: Tours of groups of points (g, k, x, y; k the place in the group from 1) in SQL, step by step: the nearest left in turn, first
#: improving reversals, all subsets, and the nearest to a growing tree.
_TOURS = {
    "d": "select a.g, a.k as a, b.k as b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as km from pt a join pt b using (g)",
    "m": "select g, max(a) as n, list(km order by a, b) as km from d group by g",
    "nn": """select g, [1::bigint] as t, 0.0::double as km from m union all
select g, list_append(t, z.b), km + z.km from (select nn.g, t, nn.km, arg_min({'b': d.b, 'km': d.km}, (round(d.km, 9), d.b)) as z from nn join d on d.g = nn.g and d.a = t[-1] where not list_contains(t, d.b) group by nn.g, t, nn.km)""",
    "nnt": "select nn.g, n, m.km as w, t, nn.km + m.km[(t[-1] - 1) * n + 1] as nn_km, nn.km as way from nn join m using (g) where len(t) = n",
    "opt": """select g, n, w, t, 2::bigint as i, 3::bigint as j, false as better, 1 as round, n < 3 as done from nnt union all
select g, n, w, case when cut then list_concat(list_concat(t[:i - 1], list_reverse(t[i:j])), t[j + 1:]) else t end, case when j < n then i when i < n - 1 then i + 1 else 2 end,
case when j < n then j + 1 when i < n - 1 then i + 2 else 3 end, case when j < n or i < n - 1 then better or cut else false end, case when j < n or i < n - 1 then round else round + 1 end, j = n and i = n - 1 and (round = 100 or not (better or cut))
from (select *, w[(t[i - 1] - 1) * n + t[j]] + w[(t[i] - 1) * n + t[j % n + 1]] < w[(t[i - 1] - 1) * n + t[i]] + w[(t[j] - 1) * n + t[j % n + 1]] - 1e-12 as cut from opt where not done)""",
    "best": "select g, list_sum(list_transform(range(1, n + 1), lambda i: w[(t[i] - 1) * n + t[i % n + 1]])) as two_opt_km from opt where done",
    "hk": """select d.g, (1::bigint << (b - 1)) as seen, b as last, d.km as km from d join m using (g) where a = 1 and b > 1 and n <= 12 union all
select hk.g, seen | (1::bigint << (d.b - 1)), d.b, min(hk.km + d.km) from hk join d on d.g = hk.g and d.a = last where d.b > 1 and seen & (1::bigint << (d.b - 1)) = 0 group by all""",
    "ex": "select hk.g, min(hk.km + d.km) as exact_km from hk join d on d.g = hk.g and d.a = last and d.b = 1 join m on m.g = hk.g where bit_count(seen) = n - 1 group by hk.g",
    "mst": """select g, [1::bigint] as t, 0.0::double as km from m union all
select g, list_append(t, z.b), km + z.km from (select mst.g, t, mst.km, arg_min({'b': d.b, 'km': d.km}, (d.km, d.b)) as z from mst join d on d.g = mst.g and list_contains(t, d.a) and not list_contains(t, d.b) group by mst.g, t, mst.km)""",
    "tree": "select mst.g, mst.km as tree_km from mst join m using (g) where len(t) = n",
}


def tours_sql(points: str, body: str, *steps: str) -> str:
    """A query over steps of _TOURS (those they need included, in their order) for groups of points."""
    needs = {"nn": ["d", "m"], "nnt": ["nn"], "opt": ["nnt"], "best": ["opt"], "hk": ["d", "m"], "ex": ["hk"], "mst": ["d", "m"], "tree": ["mst"]}
    wanted, todo = set(), list(steps)
    while todo:
        wanted.add(step := todo.pop())
        todo += needs.get(step, [])
    return f"with pt as ({points}),\n" + ",\n".join(f"{k} as ({v})" for k, v in _TOURS.items() if k in wanted) + f"\n{body}"


def cells_sql(cells: int) -> str:
    return f"select (stop % {cells})::int as g, row_number() over (partition by stop % {cells} order by stop) as k, x_km as x, y_km as y from stops"


#: Tour by the switch: exact where a group is small enough, otherwise improved; no way at all for a single point.
TOUR_SQL = "round(coalesce(case when n > 12 then two_opt_km else exact_km end, 0), 6)"


def _groups(spark, sf_dir) -> DataFrame:
    return Region(spark, sf_dir).stops().withColumn("cell", (F.col("stop") % 12).cast("int"))


def _values(d: Plane, n: int) -> dict:
    nn = nearest_neighbour(d)
    improved = round(length(d, two_opt(d, nn)), 6)
    return {"n": n, "nn_km": round(length(d, nn), 6), "two_opt_km": improved, "tour_km": improved if n > EXACT else round(tour_length(d, n), 6), "tree_km": round(spanning_tree(d), 6)}


@query("m2_two_opt", sql(tours_sql(cells_sql(12), f"select g as cell, n, round(nn_km, 6) as nn_km, round(two_opt_km, 6) as two_opt_km, {TOUR_SQL} as tour_km, round(tree_km, 6) as tree_km from nnt join best using (g) left join ex using (g) join tree using (g)", "best", "ex", "tree"), "stops", recursive=True))
def m2(spark, sf_dir):
    return per_places(_groups(spark, sf_dir), "cell", "stop", _values, "n long, nn_km double, two_opt_km double, tour_km double, tree_km double")


_NN = """with p as (select stop, stop % 12 as cell, x_km as x, y_km as y, row_number() over (partition by stop % 12 order by stop) as i from stops),
w as (select cell, x, y, [i] as seen, 0.0::double as km, x as x0, y as y0 from p where i = 1 union all
select cell, n.x, n.y, list_append(seen, n.i), km + n.d, x0, y0 from (select w.cell, w.seen, w.km, w.x0, w.y0, arg_min({'i': p.i, 'x': p.x, 'y': p.y, 'd': sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2)}, (round(sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2), 9), p.i)) as n from w join p on p.cell = w.cell and not list_contains(w.seen, p.i) group by w.cell, w.seen, w.km, w.x0, w.y0, w.x, w.y))
select cell::int as cell, len(seen)::bigint as n, round(km + sqrt((x - x0) ** 2 + (y - y0) ** 2), 6) as nn_km from w where len(seen) = (select count(*) from p where p.cell = w.cell)"""


@query("m1_nearest_neighbour_tour", sql(_NN, "stops", recursive=True))
def m1(spark, sf_dir):
    return per_places(_groups(spark, sf_dir), "cell", "stop", lambda d, n: {"n": n, "nn_km": round(length(d, nearest_neighbour(d)), 6)}, "n long, nn_km double")


@query("k9_spanning_tree", sql(tours_sql(cells_sql(12), "select g as cell, round(tree_km, 6) as tree_km from tree", "tree"), "stops", recursive=True))
def k9(spark, sf_dir):
    return per_places(_groups(spark, sf_dir), "cell", "stop", lambda d, n: {"tree_km": round(spanning_tree(d), 6)}, "tree_km double")


@query("m3_tour_switch", sql(tours_sql(cells_sql(12), f"select g as cell, {TOUR_SQL} as tour_km from nnt join best using (g) left join ex using (g)", "best", "ex"), "stops", recursive=True))
def m3(spark, sf_dir):
    return per_places(_groups(spark, sf_dir), "cell", "stop", lambda d, n: {"tour_km": round(tour_length(d, n), 6)}, "tour_km double")


@query("l16_single_stop_vehicles", sql("select stop % 12 as cell, round(sum(2 * sqrt((x_km - 2.5) ** 2 + (y_km - 2.5) ** 2)), 6) as km from stops group by 1", "stops"))
def l16(spark, sf_dir):
    """With as many vehicles as stops each makes one round trip."""
    from dispatchgrid.functions.exprs import distance

    km = 2 * distance(F.col("x_km"), F.col("y_km"), F.lit(2.5), F.lit(2.5))
    return Region(spark, sf_dir).stops().groupBy((F.col("stop") % 12).alias("cell")).agg(F.round(F.sum(km), 6).alias("km"))


@query("m5_skip_limited_path", sql("""with p as (select route, seq, x_km as x, y_km as y from stops), w as (select route, seq, 0.0::double as c1, null::double as c2, null::double as c3 from p where seq = 1 union all
select b.route, b.seq, least(c1 + sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), coalesce(c2 + sqrt((a2.x - b.x) ** 2 + (a2.y - b.y) ** 2), 1e18), coalesce(c3 + sqrt((a3.x - b.x) ** 2 + (a3.y - b.y) ** 2), 1e18)), c1, c2
from w join p a on a.route = w.route and a.seq = w.seq join p b on b.route = a.route and b.seq = a.seq + 1 left join p a2 on a2.route = w.route and a2.seq = w.seq - 1 left join p a3 on a3.route = w.route and a3.seq = w.seq - 2)
select route, round(arg_max(c1, seq), 6) as km from w group by route""", "stops", recursive=True))
def m5(spark, sf_dir):
    """Shortest way along a line that may skip at most two checkpoints in a row: a fold that keeps the last three costs."""
    s = Region(spark, sf_dir).stops().groupBy("route").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("x_km").alias("x"), F.col("y_km").alias("y")))).alias("p"))
    point = lambda i: F.get("p", i)

    def step(a, i):
        ways = [F.when(i - k >= 0, F.get(a, F.lit(k - 1)) + F.sqrt((point(i)["x"] - point(i - k)["x"]) ** 2 + (point(i)["y"] - point(i - k)["y"]) ** 2)) for k in (1, 2, 3)]
        return F.slice(F.concat(F.array(F.least(*ways)), a), 1, 3)  # the latest cost first

    later = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: i > 0)
    cost = F.aggregate(later, F.array(F.lit(0.0)), step)
    return s.select("route", F.round(F.get(cost, F.lit(0)), 6).alias("km"))


@query("l7_subpath_arcs", sql("select a.route, a.seq as cp_from, b.seq as cp_to, round(sqrt((a.x_km - b.x_km) ** 2 + (a.y_km - b.y_km) ** 2), 6) as km from stops a join stops b on a.route = b.route and b.seq > a.seq and b.seq <= a.seq + 2 where sqrt((a.x_km - b.x_km) ** 2 + (a.y_km - b.y_km) ** 2) / 30 <= 0.1", "stops"))
def l7(spark, sf_dir):
    """Direct arcs between checkpoints at most one skip apart and within the time budget: an explode and an equi-join."""
    from dispatchgrid.functions.exprs import distance

    s = Region(spark, sf_dir).stops()
    a = s.select("route", F.col("seq").alias("cp_from"), F.col("x_km").alias("ax"), F.col("y_km").alias("ay"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("cp_to", F.col("cp_from") + F.col("k"))
    b = s.select("route", F.col("seq").alias("cp_to"), F.col("x_km").alias("bx"), F.col("y_km").alias("by"))
    km = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(b, ["route", "cp_to"]).where(km / 30 <= 0.1).select("route", F.col("cp_from").cast("bigint").alias("cp_from"), F.col("cp_to").cast("bigint").alias("cp_to"), F.round(km, 6).alias("km"))
