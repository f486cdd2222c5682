"""Local search of centres by swaps, as aggregations over pairs of places.

A round prices every swap of a centre for another place, of every restart, in one pass: each place knows its nearest and its
second nearest centre, so a swap (out, in) costs it the less of `in` and the nearest, or, where `out` was its nearest, of `in`
and the second. Summed by (in, nearest) this gives all costs: the sum over all nearest centres, plus for `out` what its own
places lose. The best swap of each restart is taken until none pays. Pairs are rows; the driver has the centres of each
restart, a few numbers. As swaps may end short of the least, all sets are priced after them. Points at one place count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import distance, hash_uniform
from dispatchgrid.functions.kept import keep
from dispatchgrid.plans.region import Region, sql

RESTARTS = 12


def near_two(pairs: DataFrame, centers: DataFrame) -> DataFrame:
    """restart, src, near, d1, d2: the nearest centre of each place, and the costs of it and of the next."""
    first = F.array_sort(F.collect_list(F.struct("cost", "center")))  # as many as there are centres
    at = pairs.join(F.broadcast(centers), F.col("dst") == F.col("center")).groupBy("restart", "src").agg(first.alias("c"))
    return at.select("restart", "src", F.get("c", F.lit(0))["center"].alias("near"), F.get("c", F.lit(0))["cost"].alias("d1"), F.coalesce(F.get("c", F.lit(1))["cost"], F.lit(float("inf"))).alias("d2"))


def swap_prices(pairs: DataFrame, centers: DataFrame) -> DataFrame:
    """restart, out, in, cost of the whole after each swap."""
    near = near_two(pairs, centers)
    each = near.join(pairs.select("src", F.col("dst").alias("in"), "cost"), "src")
    stays, goes = F.least("d1", "cost"), F.least("d2", "cost")
    sums = each.groupBy("restart", "in", "near").agg(F.sum(stays).alias("stays"), F.sum(goes).alias("goes"))
    whole = sums.groupBy("restart", "in").agg(F.sum("stays").alias("total"), F.collect_list(F.struct("near", "stays", "goes")).alias("own"))  # as many as centres
    priced = whole.select("restart", "in", "total", F.explode("own").alias("o")).select("restart", F.col("o.near").alias("out"), "in", (F.col("total") - F.col("o.stays") + F.col("o.goes")).alias("cost"))
    return priced.join(F.broadcast(centers.select("restart", F.col("center").alias("in"))), ["restart", "in"], "left_anti")


def swap_search(pairs: DataFrame, k: int, restarts: int = RESTARTS) -> tuple[dict[int, list], dict[int, float], DataFrame]:
    """Centres and cost of each restart once no swap pays, and the prices of all swaps then. pairs: src, dst, cost (weighted)."""
    spark = pairs.sparkSession
    pairs = keep(pairs.select("src", "dst", "cost").repartition("src"), "pairs")
    kind = pairs.schema["src"].dataType.simpleString()
    places = pairs.select("src").distinct()
    held: dict[int, list] = {}
    starts = places.crossJoin(F.broadcast(spark.range(restarts, numPartitions=1).select(F.col("id").alias("r"))))
    first = starts.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy(hash_uniform(F.col("r") * 1000003 + F.col("src"), "swap"), "src"))).where(F.col("n") <= k)
    for x in first.collect():
        held.setdefault(x["r"], []).append(x["src"])
    held = {r: sorted(held[r]) for r in sorted(held)}
    cost = {}
    while True:
        centers = spark.createDataFrame([(r, c) for r, cs in held.items() for c in cs], f"restart int, center {kind}")
        if not cost:
            cost = {r["restart"]: r["cost"] for r in near_two(pairs, centers).groupBy("restart").agg(F.sum("d1").alias("cost")).collect()}
        prices = swap_prices(pairs, centers)
        best = prices.groupBy("restart").agg(F.min_by(F.struct("out", "in", "cost"), F.struct(F.round("cost", 9), "out", "in")).alias("b"))
        moved = False
        for r in best.collect():
            s, (out, into, price) = r["restart"], r["b"]
            if price < cost[s] - 1e-9:
                held[s], cost[s], moved = sorted([c for c in held[s] if c != out] + [into]), price, True
        if not moved:
            return held, cost, prices


def all_sets(pairs: DataFrame, k: int, again: bool = False) -> DataFrame:
    """centers (array, ascending), cost of every set of k places, or of every selection with repeats. A row holds what its
    centres cost each place, so a set is an array, and the sets of one first centre are a task's own."""
    column = F.transform(F.array_sort(F.collect_list(F.struct("src", "cost"))), lambda p: p["cost"])
    one = keep(pairs.groupBy("dst").agg(column.alias("more")), "columns")
    sets = one.repartition(64, "dst").select(F.array("dst").alias("centers"), F.col("more").alias("costs"))
    for _ in range(k - 1):
        last = F.element_at("centers", -1)
        sets = sets.join(one, last <= F.col("dst") if again else last < F.col("dst"))
        sets = sets.select(F.concat("centers", F.array("dst")).alias("centers"), F.zip_with("costs", "more", lambda x, y: F.least(x, y)).alias("costs"))
    return sets.select("centers", F.aggregate("costs", F.lit(0.0), lambda s, x: s + x).alias("cost"))


def best_sets(pairs: DataFrame, k: int, restarts: int = RESTARTS, again: bool = False) -> DataFrame:
    """centers, cost of all sets of the least cost at six digits. Swaps from several starts end where no single swap pays, which
    may be short of the least; so every set is priced after them, and those dearer than what they found are dropped."""
    _, found, _ = swap_search(pairs, k, restarts)
    sets = keep(all_sets(pairs, k, again).where(F.col("cost") <= min(found.values()) + 1e-6), "sets")
    least = sets.agg(F.min(F.round("cost", 6)).alias("least"))
    return sets.join(F.broadcast(least), F.round("cost", 6) == F.col("least")).select("centers", F.col("least").alias("cost"))


def some_swap_pays(pairs: DataFrame, centers: list, cost: float) -> bool:
    kind = pairs.schema["src"].dataType.simpleString()
    prices = swap_prices(pairs, pairs.sparkSession.createDataFrame([(0, c) for c in set(centers)], f"restart int, center {kind}"))
    return not prices.where(F.col("cost") < cost - 1e-6).isEmpty()


def best_centers(pairs: DataFrame, k: int, restarts: int = RESTARTS) -> DataFrame:
    """centers (text, in order; of equal sets the first by text), cost of the best set, and whether some swap of it still pays."""
    pairs = keep(pairs, "pairs")
    text = F.array_join(F.transform("centers", lambda c: c.cast("string")), ",")
    best = best_sets(pairs, k, restarts).orderBy(text).select(text.alias("centers"), "centers", "cost").toDF("text", "centers", "cost").first()
    return pairs.sparkSession.createDataFrame([(best["text"], best["cost"], some_swap_pays(pairs, best["centers"], best["cost"]))], "centers string, cost double, pays boolean")


def best_two_of_places(points: DataFrame, restarts: int) -> DataFrame:
    """Two centres of points (id, x, y, weight) as `best_centers` gives them. Points at one place are one row of its weight while
    centres are looked for; of equal sets the first by text is then found among the points at their places."""
    at = keep(points.groupBy("x", "y").agg(F.min("id").alias("place"), F.max("id").alias("last"), F.sum("weight").alias("weight")), "places")
    a, b = at.select(F.col("place").alias("src"), "x", "y", "weight"), at.select(F.col("place").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = keep(a.crossJoin(b).select("src", "dst", (F.col("weight") * distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).alias("cost")), "pairs")
    sets = keep(best_sets(pairs, 2, restarts, again=True).select(F.col("centers")[0].alias("p"), F.col("centers")[1].alias("q"), "cost"), "sets")
    own = points.join(at.select("x", "y", "place"), ["x", "y"]).select("id", "place")
    ways = sets.unionByName(sets.select(F.col("q").alias("p"), F.col("p").alias("q"), "cost"))
    # The lower number comes first, and texts of it decide before the other's do.
    low = own.join(ways.join(at.select(F.col("place").alias("q"), "last"), "q"), F.col("place") == F.col("p")).where(F.col("id") < F.col("last"))
    low = low.groupBy("p", "q", "cost").agg(F.min_by("id", F.concat(F.col("id").cast("string"), F.lit(","))).alias("i"))
    text = F.concat_ws(",", F.col("i").cast("string"), F.col("id").cast("string"))
    best = own.join(low, F.col("place") == F.col("q")).where(F.col("id") > F.col("i")).groupBy("p", "q", "cost").agg(F.min(text).alias("centers")).orderBy("centers").first()
    rows = [(best["centers"], best["cost"], some_swap_pays(pairs, [best["p"], best["q"]], best["cost"]))] if best else [(None, None, False)]
    return points.sparkSession.createDataFrame(rows, "centers string, cost double, pays boolean")


_THREE = """w as (select b.block, coalesce(p, 0) + 0.01::double as w from blocks b left join demand using (block)), d as (select src, dst, km * w as c from dist join w on w.block = src),
t as (select a.block as i, b.block as j, c.block as k from blocks a, blocks b, blocks c where a.block < b.block and b.block < c.block),
v as (select i, j, k, sum(least(x.c, y.c, z.c)) as cost from t join d x on x.dst = i join d y on y.dst = j and y.src = x.src join d z on z.dst = k and z.src = x.src group by i, j, k)"""


@query("l6_swap_medians", sql(f"with {_THREE} select arg_min(i || ',' || j || ',' || k, (round(cost, 6), i || ',' || j || ',' || k)) as centers, round(min(cost), 6) as cost, false as pays from v", "blocks", "demand", "dist"))
def l6_swap_medians(spark, sf_dir):
    """Three centres of the blocks, by demand; the least cost of all triples, found by swaps."""
    r = Region(spark, sf_dir)
    w = r.blocks().join(r.demand(), "block", "left").select(F.col("block").alias("src"), (F.coalesce("p", F.lit(0.0)) + 0.01).alias("w"))
    return best_centers(r.distances().join(w, "src").select("src", "dst", (F.col("km") * F.col("w")).alias("cost")), 3)


@query("l6_swap_stops", sql("""with d as (select a.stop as src, b.stop as dst, a.secs * sqrt((a.x_km - b.x_km) ** 2 + (a.y_km - b.y_km) ** 2) as c from stops a, stops b), v as (select x.dst as i, y.dst as j, sum(least(x.c, y.c)) as cost from d x join d y on x.src = y.src and x.dst < y.dst group by 1, 2)
select arg_min(i || ',' || j, (round(cost, 6), i || ',' || j)) as centers, round(min(cost), 6) as cost, false as pays from v""", "stops"))
def l6_swap_stops(spark, sf_dir):
    """Two centres of all stops, by the seconds spent at them."""
    s = Region(spark, sf_dir).stops()
    return best_two_of_places(s.select(F.col("stop").alias("id"), F.col("x_km").alias("x"), F.col("y_km").alias("y"), F.col("secs").alias("weight")), 6)
