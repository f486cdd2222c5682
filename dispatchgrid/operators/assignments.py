"""Riders and blocks assigned to service points with conditions and fall-backs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import SPEED_KMH, distance
from dispatchgrid.operators.nearest import nearest, nearest_segment
from dispatchgrid.operators.polygons import riders_at
from dispatchgrid.operators.scenarios import _RIDERS, riders
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)
_D = "sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2)"


@query("c10_nearest_segment", sql("""with g as (select x_km as ax, y_km as ay, lead(x_km) over (partition by route order by seq) as bx, lead(y_km) over (partition by route order by seq) as b_y from stops),
d as (select block, x_km, y_km, ax, ay, bx, b_y, (bx - ax) ** 2 + (b_y - ay) ** 2 as l from blocks, g where bx is not null),
f as (select *, case when l <= 0 then 0 else greatest(0.0, least(1.0, ((x_km - ax) * (bx - ax) + (y_km - ay) * (b_y - ay)) / nullif(l, 0))) end as t from d)
select block, round(min(sqrt((x_km - ax - t * (bx - ax)) ** 2 + (y_km - ay - t * (b_y - ay)) ** 2)), 6) as km from f group by block""", "stops", "blocks"))
def c10(spark, sf_dir):
    """Distance from each block to the nearest line."""
    r = Region(spark, sf_dir)
    w = Window.partitionBy("route").orderBy("seq")
    g = r.stops().select(F.col("x_km").alias("ax"), F.col("y_km").alias("ay"), F.lead("x_km").over(w).alias("bx"), F.lead("y_km").over(w).alias("by")).where("bx is not null")
    return nearest_segment(r.blocks(), g.withColumn("at", F.struct("ax", "ay", "bx", "by")), "block", "at").select("block", R6("km", "km"))


@query("c10_nearest_segment_of_riders", sql("""with g as (select stop, x_km as ax, y_km as ay, lead(x_km) over (partition by route order by seq) as bx, lead(y_km) over (partition by route order by seq) as b_y from stops),
p as (select c_custkey, (c_custkey * 104729) % 6007 / 1000.0::double as x, (c_custkey * 1299709) % 5501 / 1000.0::double as y from customer),
h as (select stop, ax, ay, ax + (bx - ax) / 20 as bx, ay + (b_y - ay) / 20 as b_y from g where bx is not null),
d as (select *, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) as l from p, h), f as (select *, case when l <= 0 then 0 else greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / nullif(l, 0))) end as t from d),
e as (select c_custkey, stop, sqrt((x - (ax + t * (bx - ax))) ** 2 + (y - (ay + t * (b_y - ay))) ** 2) as km from f)
select c_custkey, arg_min(stop, (round(km, 9), stop)) as stop, round(min(km), 6) as km from e group by c_custkey""", "stops"))
def c10_riders(spark, sf_dir):
    """The short piece of line nearest to each customer: pieces dealt to the cells they run through, cells that widen."""
    r = Region(spark, sf_dir)
    w = Window.partitionBy("route").orderBy("seq")
    g = r.stops().select("stop", F.col("x_km").alias("ax"), F.col("y_km").alias("ay"), F.lead("x_km").over(w).alias("nx"), F.lead("y_km").over(w).alias("ny")).where("nx is not null")
    pieces = g.select("stop", "ax", "ay", (F.col("ax") + (F.col("nx") - F.col("ax")) / 20).alias("bx"), (F.col("ay") + (F.col("ny") - F.col("ay")) / 20).alias("by"))
    return nearest_segment(riders_at(r), pieces, "c_custkey", "stop").select("c_custkey", F.col("pick").alias("stop"), R6("km", "km"))


@query("c15_nearest_node", sql(f"select stop, arg_min(block, (round({_D}, 9), block)) as node from stops s, blocks b group by stop", "stops", "blocks"))
def c15(spark, sf_dir):
    r = Region(spark, sf_dir)
    return nearest(r.stops(), r.blocks(), "stop", "block").select("stop", F.col("pick").alias("node"))


_KM = "sqrt((x - sx) ** 2 + (y - sy) ** 2)"


@query("c17_fallback_point", sql(_RIDERS + f""", c as (select block as site, x_km as sx, y_km as sy from blocks where block % 2 = 0),
a as (select s, block, k, arg_min(site, (round({_KM}, 9), site)) as site from rider, c group by s, block, k),
f as (select s, block, k, arg_min(site, (round({_KM}, 9), site)) as other from rider, c where site % 4 <> 2 group by s, block, k)
select s, block, k::int as k, case when site % 4 = 2 then other else site end as site, site % 4 = 2 as reassigned from a join f using (s, block, k)""", "demand", "blocks"))
def c17(spark, sf_dir):
    """Nearest service point; where that one isn't served, the nearest served one: both in one aggregation."""
    r = Region(spark, sf_dir)
    c = r.blocks().where("block % 2 = 0").select(F.col("block").alias("site"), F.col("x_km").alias("sx"), F.col("y_km").alias("sy"))
    at = F.struct(F.round(distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")), 9), "site")
    served = F.col("site") % 4 != 2
    g = riders(r).crossJoin(F.broadcast(c)).groupBy("s", "block", "k").agg(F.min_by("site", at).alias("first"), F.min_by("site", F.when(served, at)).alias("other"))
    gone = F.col("first") % 4 == 2
    return g.select("s", "block", "k", F.when(gone, F.col("other")).otherwise(F.col("first")).alias("site"), gone.alias("reassigned"))


@query("c18_checkpoint_or_stop", sql(_RIDERS + f""", c as (select block as site, x_km as sx, y_km as sy from blocks),
a as (select s, block, k, min({_KM}) filter (where site % 3 = 0) as cp, min({_KM}) filter (where site % 3 = 1) as st, arg_min(site, (round({_KM}, 9), site)) filter (where site % 3 = 1) as stop from rider, c group by s, block, k)
select s, count(*) filter (where st < cp and stop % 2 = 1)::bigint as at_stop, count(*)::bigint as riders, round(avg(case when st < cp and stop % 2 = 1 then st else cp end), 6) as walk_km from a group by s""", "demand", "blocks"))
def c18(spark, sf_dir):
    """A rider boards at a stop off the line when it is nearer than the nearest checkpoint and served, else at the checkpoint."""
    r = Region(spark, sf_dir)
    c = r.blocks().select(F.col("block").alias("site"), F.col("x_km").alias("sx"), F.col("y_km").alias("sy"))
    km = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    of = lambda m, v: F.when(F.col("site") % 3 == m, v)
    g = riders(r).crossJoin(F.broadcast(c)).groupBy("s", "block", "k").agg(F.min(of(0, km)).alias("cp"), F.min(of(1, km)).alias("st"), F.min_by("site", of(1, F.struct(F.round(km, 9), "site"))).alias("stop"))
    off = (F.col("st") < F.col("cp")) & (F.col("stop") % 2 == 1)
    return g.groupBy("s").agg(F.count_if(off).alias("at_stop"), F.count("*").alias("riders"), R6(F.avg(F.when(off, F.col("st")).otherwise(F.col("cp"))), "walk_km"))


@query("f7_worst_walk", sql(f"with n as (select block, min({_D}) as km, arg_min(secs, (round({_D}, 9), route, seq)) as secs from blocks b, stops s group by block) select arg_max(block, (round(km, 9), block)) as block, round(max(km), 6) as walk_km, round(arg_max(secs, (round(km, 9), block)) / 3600.0 + max(km) / 5.0, 6) as total_h from n", "blocks", "stops"))
def f7(spark, sf_dir):
    r = Region(spark, sf_dir)
    n = nearest(r.blocks(), r.stops().withColumn("rank", F.struct("route", "seq", "secs")), "block", "rank")
    worst = n.agg(F.max_by(F.struct("block", "km", F.col("pick.secs").alias("secs")), F.struct(F.round("km", 9), "block")).alias("w"))
    return worst.select("w.block", R6("w.km", "walk_km"), R6(F.col("w.secs") / 3600.0 + F.col("w.km") / 5.0, "total_h"))


@query("f8_worst_walk_per_route", sql(f"with n as (select block, arg_min(route, (round({_D}, 9), route, seq)) as route, min({_D}) as km from blocks b, stops s group by block) select route, arg_max(block, (round(km, 9), block)) as block, round(max(km), 6) as walk_km from n group by route", "blocks", "stops"))
def f8(spark, sf_dir):
    r = Region(spark, sf_dir)
    n = nearest(r.blocks(), r.stops().withColumn("rank", F.struct("route", "seq")), "block", "rank").withColumn("route", F.col("pick.route"))
    return n.groupBy("route").agg(F.max_by("block", F.struct(F.round("km", 9), "block")).alias("block"), R6(F.max("km"), "walk_km"))


@query("o4_fixed_route", sql(f"""with n as (select block, arg_min(route, (round({_D}, 9), route, seq)) as route, min({_D}) as km from blocks b, stops s group by block),
c as (select route, sum(secs) / 3600.0 as cycle_h from stops group by route), x as (select n.route, coalesce(p, 0) as p, km, cycle_h from n join c using (route) left join demand using (block))
select round(sum(p * km) / sum(p), 6) as walk_km, round(sum(p * cycle_h / 2) / sum(p), 6) as wait_h, round(max(km / 5.0 + cycle_h), 6) as worst_h, round(sum(p * (km / 5.0 + cycle_h / 2 + km / {SPEED_KMH})) / sum(p), 6) as user_h from x""", "blocks", "stops", "demand"))
def o4(spark, sf_dir):
    """Walk to the nearest stop, half a cycle's wait, one vehicle a route."""
    r = Region(spark, sf_dir)
    n = nearest(r.blocks(), r.stops().withColumn("rank", F.struct("route", "seq")), "block", "rank").select("block", F.col("pick.route").alias("route"), "km")
    c = r.stops().groupBy("route").agg((F.sum("secs") / 3600.0).alias("cycle_h"))
    x = n.join(F.broadcast(c), "route").join(r.demand(), "block", "left").fillna(0.0, ["p"])
    mean = lambda v: F.sum(F.col("p") * v) / F.sum("p")
    km, h = F.col("km"), F.col("cycle_h")
    return x.agg(R6(mean(km), "walk_km"), R6(mean(h / 2), "wait_h"), R6(F.max(km / 5.0 + h), "worst_h"), R6(mean(km / 5.0 + h / 2 + km / SPEED_KMH), "user_h"))
