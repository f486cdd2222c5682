"""Shortest paths, reachability and local-search moves over the block graph, and partitions by lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.kept import keep
from dispatchgrid.operators.sets import MEDOID_SQL, f3
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


def shortest_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """src, dst, km of the shortest paths from each seed: rounds of relaxation until nothing improves.

    Each round extends only what the last one improved and keeps the least km per pair with a combining aggregation.
    Rounds are written to the shared folder, which cuts the plan.
    """
    e = edges.select(F.col("src").alias("via"), F.col("dst").alias("to"), F.col("km").alias("step"))
    best = seeds.select(F.col("block").alias("src"), F.col("block").alias("dst"), F.lit(0.0).alias("km"))
    frontier = best
    while True:
        longer = frontier.join(e, F.col("dst") == F.col("via")).groupBy("src", F.col("to").alias("dst")).agg(F.min(F.col("km") + F.col("step")).alias("new"))
        better = longer.join(best, ["src", "dst"], "left").where(F.col("km").isNull() | (F.col("new") < F.col("km") - 1e-12)).select("src", "dst", F.col("new").alias("km"))
        better = keep(better)
        if not better.limit(1).count():
            return best
        best = keep(best.unionByName(better).groupBy("src", "dst").agg(F.min("km").alias("km")))
        frontier = better


@query("k1_all_pairs", sql("select src, dst, abs((src % 5) - (dst % 5)) + abs((src // 5) - (dst // 5))::double as km from dist", "blocks", "dist"))
def k1(spark, sf_dir):
    """All pairs over the contiguity edges; on the unit grid the length is the city-block distance."""
    r = Region(spark, sf_dir)
    return shortest_paths(r.edges(), r.blocks())


@query("k2_paths_with_fallback", sql("select dst as block, round(case when dst % 5 < 4 then abs(dst % 5) + (dst // 5) else sqrt((dst % 5) ** 2 + (dst // 5) ** 2) end, 6) as km from dist where src = 0", "blocks", "dist"))
def k2(spark, sf_dir):
    """From one block over the edges left when the last column is cut off; straight lines where no path remains."""
    r = Region(spark, sf_dir)
    inner = r.edges().where("src % 5 < 4 and dst % 5 < 4")
    paths = shortest_paths(inner, r.blocks().where("block = 0")).select(F.col("dst").alias("block"), "km")
    straight = F.sqrt(F.col("x_km") * F.col("x_km") + F.col("y_km") * F.col("y_km"))
    return r.blocks().join(paths, "block", "left").select("block", R6(F.coalesce("km", straight), "km"))


@query("k3_symmetrise", sql("with d as (select src, dst, km * (1 + (src % 3) * 0.1) as km from dist) select a.src, a.dst, round(case when a.src = a.dst then 0 else 0.5 * (a.km + b.km) end, 6) as km from d a join d b on a.src = b.dst and a.dst = b.src", "blocks", "dist"))
def k3(spark, sf_dir):
    d = Region(spark, sf_dir).distances().withColumn("km", F.col("km") * (1 + (F.col("src") % 3) * 0.1))
    back = d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("km").alias("back"))
    return d.join(back, ["src", "dst"]).select("src", "dst", R6(F.when(F.col("src") == F.col("dst"), 0.0).otherwise(0.5 * (F.col("km") + F.col("back"))), "km"))


@query("k6_contiguity_check", sql("""with walk as (select district, min(block) as block from blocks group by district union select b.district, e.dst from walk w join edges e on e.src = w.block join blocks b on b.block = e.dst and b.district = w.district)
select district, (select count(*) from walk where walk.district = b.district) = count(*) as contiguous from blocks b group by district""", "blocks", "edges", recursive=True))
def k6(spark, sf_dir):
    """A district is contiguous when all of it is reached from its first block along edges inside it."""
    r = Region(spark, sf_dir)
    d = r.blocks().select("block", "district")
    inside = r.edges().join(d.select(F.col("block").alias("src"), F.col("district").alias("d1")), "src").join(d.select(F.col("block").alias("dst"), F.col("district").alias("d2")), "dst").where("d1 = d2").select("src", "dst", "km")
    first = d.groupBy("district").agg(F.min("block").alias("block"))
    reached = shortest_paths(inside, first).join(first.select(F.col("block").alias("src"), "district"), "src").groupBy("district").agg(F.count("*").alias("n"))
    return d.groupBy("district").agg(F.count("*").alias("size")).join(reached, "district").select("district", (F.col("n") == F.col("size")).alias("contiguous"))


@query("k7_center_neighbours", sql("select distinct dst as block from edges where src in (0, 7, 12) and dst not in (0, 7, 12)", "edges"))
def k7(spark, sf_dir):
    r = Region(spark, sf_dir)
    c = r.blocks().where(F.col("block").isin(0, 7, 12)).select("block")
    return r.edges().join(c, F.col("src") == F.col("block"), "left_semi").select(F.col("dst").alias("block")).distinct().join(c, "block", "left_anti")


@query("k8_hull", sql("""with p as (select stop, x_km as x, y_km as y from stops), e as (select a.stop as a, b.stop as b from p a join p b on a.stop <> b.stop join p c on true group by a.stop, b.stop having max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) <= 1e-9)
select distinct a as stop from (select a from e union select b from e) h(a) where not exists (select 1 from p q1, p q2, p p0 where p0.stop = h.a and q1.stop <> h.a and q2.stop <> h.a and q1.stop <> q2.stop and abs((q1.x - p0.x) * (q2.y - p0.y) - (q1.y - p0.y) * (q2.x - p0.x)) <= 1e-9 and (q1.x - p0.x) * (q2.x - p0.x) + (q1.y - p0.y) * (q2.y - p0.y) < 0)""", "stops"))
def k8(spark, sf_dir):
    """Corners of the convex hull: each task reduces its places to their own hull, and these are joined eight by eight.

    All stops at a corner are returned.
    """
    import pandas as pd

    def chain(frames):
        seen = [f for f in frames if len(f)]
        if not seen:
            return
        pts = list(pd.concat(seen).drop_duplicates().sort_values(["x", "y"]).itertuples(index=False))
        out = set()
        for order in (pts, pts[::-1]):
            hull = []
            for q in order:
                while len(hull) > 1 and (hull[-1].x - hull[-2].x) * (q.y - hull[-2].y) - (hull[-1].y - hull[-2].y) * (q.x - hull[-2].x) <= 1e-9:
                    hull.pop()
                hull.append(q)
            out |= {(q.x, q.y) for q in hull}
        yield pd.DataFrame(sorted(out), columns=["x", "y"])

    p = Region(spark, sf_dir).stops().select("stop", F.col("x_km").alias("x"), F.col("y_km").alias("y"))
    schema = "x double, y double"
    corners = keep(p.select("x", "y").mapInPandas(chain, schema))
    n = corners.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // 8)
        corners = keep(corners.repartition(n).mapInPandas(chain, schema))
    return p.join(F.broadcast(corners), ["x", "y"]).select("stop")


@query("k10_voronoi_raster", sql("select cell, arg_min(district, (round((cx - mx) ** 2 + (cy - my) ** 2, 9), district)) as district from (select i * 40 + j as cell, (i + 0.5) / 8 as cx, (j + 0.5) / 8 as cy from (select unnest(range(40)) as i), (select unnest(range(40)) as j)), (select district, avg(x_km) as mx, avg(y_km) as my from blocks group by district) group by cell", "blocks"))
def k10(spark, sf_dir):
    from dispatchgrid.operators.joins import grid
    from dispatchgrid.operators.nearest import nearest

    c = Region(spark, sf_dir).blocks().groupBy("district").agg(F.avg("x_km").alias("x_km"), F.avg("y_km").alias("y_km"))
    return nearest(grid(spark, 40, 5.0), c, "cell", "district").select("cell", F.col("pick").alias("district"))


@query("k11_grid_instance", sql("select i::int as block, (i % m)::int as col, (i // m)::int as row, round(100.0::double / (m * m), 6) as area from (select c_custkey as i from customer), (select floor(sqrt(count(*)))::bigint as m from customer) where i < m * m"))
def k11(spark, sf_dir):
    """The largest square grid that there are customers for, ten kilometres wide."""
    c = Region(spark, sf_dir).table("customer")
    m = int(c.count() ** 0.5)
    i = F.col("c_custkey").cast("int")
    return c.where(i < m * m).select(i.alias("block"), (i % m).alias("col"), F.floor(i / m).cast("int").alias("row"), F.round(F.lit(100.0) / (m * m), 6).alias("area"))


_ANGLES = 360


@query("k12_ham_sandwich", sql(f"""with b as (select block, x_km, y_km, coalesce(p, 0) as p from blocks left join demand using (block)), r as (select a, block, sum(p) over w as mass, count(*) over w as n from b, (select unnest(range({_ANGLES})) as a) window w as (partition by a order by round(x_km * cos(a * 2 * pi() / {_ANGLES}) + y_km * sin(a * 2 * pi() / {_ANGLES}), 9) desc, block rows unbounded preceding))
select arg_min(a, (round(abs(mass - 0.5) + abs(n / every - 0.5), 9), a, n))::bigint as angle, round(min(abs(mass - 0.5) + abs(n / every - 0.5)), 6) as error from r, (select count(*)::double as every from blocks)""", "blocks", "demand"))
def k12(spark, sf_dir):
    """Over angles, the line that comes nearest to halving both demand and area."""
    r = Region(spark, sf_dir)
    b = r.blocks().join(r.demand(), "block", "left").crossJoin(F.broadcast(spark.range(_ANGLES).withColumnRenamed("id", "a")))
    ang = F.col("a") * (2 * math.pi / _ANGLES)
    w = Window.partitionBy("a").orderBy(F.desc(F.round(F.col("x_km") * F.cos(ang) + F.col("y_km") * F.sin(ang), 9)), "block").rowsBetween(Window.unboundedPreceding, 0)
    b = b.select("a", F.sum(F.coalesce("p", F.lit(0.0))).over(w).alias("mass"), F.count("*").over(w).alias("n"))
    error = F.abs(F.col("mass") - 0.5) + F.abs(F.col("n") / float(r.blocks().count()) - 0.5)
    return b.agg(F.min_by("a", F.struct(F.round(error, 9), "a", "n")).alias("angle"), R6(F.min(error), "error"))


@query("k13_half_spaces", sql("select block, sign(round(0.8 * (x_km - 2) + 0.6 * (y_km - 2), 9))::int as side from blocks", "blocks"))
def k13(spark, sf_dir):
    return Region(spark, sf_dir).blocks().select("block", F.signum(F.round(0.8 * (F.col("x_km") - 2) + 0.6 * (F.col("y_km") - 2), 9)).cast("int").alias("side"))


@query("m9_vertical_strips", sql("with s as (select block, least(2, floor(x_km / (5.0 / 3)))::int as strip from blocks) select strip, count(*)::bigint as n, (list(block order by block))[count(*)::int // 2 + 1] as root from s group by strip", "blocks"))
def m9(spark, sf_dir):
    """Equal strips by x; the root is the member in the middle of block order."""
    s = Region(spark, sf_dir).blocks().select("block", F.least(F.lit(2), F.floor(F.col("x_km") / (5.0 / 3)).cast("int")).alias("strip"))
    members = F.array_sort(F.collect_list("block"))
    return s.groupBy("strip").agg(F.count("*").alias("n"), F.get(members, F.floor(F.count("*") / 2).cast("int")).alias("root"))


def lloyd(r: Region, roots: DataFrame) -> DataFrame:
    """block, root: alternate nearest-centre assignment and one-median recentring until the centres stay or come again."""
    d = keep(r.distances())
    centers = roots.select(F.col("root").alias("center"))
    seen = []
    while True:
        near = d.join(F.broadcast(centers), F.col("dst") == F.col("center")).groupBy(F.col("src").alias("block")).agg(F.min_by("center", F.struct(F.round("km", 9), "center")).alias("root"))
        near = keep(near)
        a, b = near.select(F.col("block").alias("src"), "root"), near.select(F.col("block").alias("dst"), "root")
        totals = a.join(b, "root").join(d, ["src", "dst"]).groupBy("root", "src").agg(F.sum("km").alias("s"))
        centers = keep(totals.groupBy("root").agg(F.min_by("src", F.struct(F.round("s", 9), "src")).alias("center")).select("center"))
        now = centers.agg(F.sort_array(F.collect_list("center"))).first()[0]  # one entry per district
        if now in seen:
            return near
        seen.append(now)


_LLOYD = f"""with f as ({MEDOID_SQL}),
w as (select list(root order by root) as c, [list(root order by root)::varchar][:0] as seen, list(root order by root) as used, false as done from f union all
select z.c, list_append(seen, z.c::varchar), w.c, list_contains(seen, z.c::varchar) from w, lateral (select list(q.center order by q.center) as c from (select arg_min(src, (round(s, 9), src)) as center from
(select a.root, a.block as src, sum(d.km) as s from (select src as block, arg_min(dst, (round(km, 9), dst)) as root from dist where list_contains(w.c, dst) group by src) a join (select src as block, arg_min(dst, (round(km, 9), dst)) as root from dist where list_contains(w.c, dst) group by src) b on a.root = b.root join dist d on d.src = a.block and d.dst = b.block group by a.root, a.block) group by root) q) z where not done)
select src as block, arg_min(dst, (round(km, 9), dst)) as root from dist, w where done and list_contains(used, dst) group by src"""


@query("l6_lloyd_partition", sql(_LLOYD, "blocks", "dist", recursive=True))
def l6(spark, sf_dir):
    return lloyd(Region(spark, sf_dir), f3(spark, sf_dir))
