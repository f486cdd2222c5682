"""Samplers, reports and helpers built from the other operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions import exprs as E
from dispatchgrid.operators.evaluate import ARRIVALS, TERMS_SQL, WR, _terms, newton_sql
from dispatchgrid.operators.scenarios import _Q, _RIDERS, _requests, scenario_demand
from dispatchgrid.functions.ordered import Ordered
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)
_V = ("blocks", "demand", "odd", "dist", "depot")


@query("f10_sorted_union", sql("select * from (select o_orderpriority as baseline, o_orderstatus as wr, count(*)::bigint as n from orders group by all union all select 'all', o_orderstatus, count(*)::bigint from orders group by o_orderstatus) order by baseline, wr"))
def f10(spark, sf_dir):
    o = Region(spark, sf_dir).table("orders")
    a = o.groupBy(F.col("o_orderpriority").alias("baseline"), F.col("o_orderstatus").alias("wr")).agg(F.count("*").alias("n"))
    b = a.groupBy("wr").agg(F.sum("n").alias("n")).withColumn("baseline", F.lit("all"))
    return a.unionByName(b).orderBy("baseline", "wr")


@query("f13_best_restart", sql(f"with r as (select i, sum(km * {E.uniform_sql('i * 1000 + dst', 'restart')}) as cost from dist, (select unnest(range(50)) as i) where src = 12 group by i) select arg_min(i, (round(cost, 9), i))::bigint as restart, round(min(cost), 6) as cost from r", "blocks", "dist"))
def f13(spark, sf_dir):
    """Best of fifty seeded restarts, each a row."""
    d = Region(spark, sf_dir).distances().where("src = 12").crossJoin(F.broadcast(spark.range(50).withColumnRenamed("id", "i")))
    c = d.groupBy("i").agg(F.sum(F.col("km") * E.hash_uniform(F.col("i") * 1000 + F.col("dst"), "restart")).alias("cost"))
    return c.agg(F.min_by("i", F.struct(F.round("cost", 9), "i")).alias("restart"), R6(F.min("cost"), "cost"))


@query("h10_difficulty_rank", sql("select p_partkey, (case split_part(p_type, ' ', 1) when 'PROMO' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 else 7 end)::int as rank from part"))
def h10(spark, sf_dir):
    table = F.create_map(*(F.lit(x) for kv in {"PROMO": 1, "LARGE": 2, "MEDIUM": 3}.items() for x in kv))
    return Region(spark, sf_dir).table("part").select("p_partkey", F.coalesce(F.element_at(table, F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit(7)).alias("rank"))


@query("h13_iso_time", sql("select event_id, year(t)::int as y, hour(t)::int as h from (select event_id, case when user_id % 5 = 0 then timestamp '0001-01-01' else ts end as t from events)"))
def h13(spark, sf_dir):
    """ISO texts with a Z parsed; what is none counts as the earliest time."""
    e = Region(spark, sf_dir).table("events")
    text = F.when(F.col("user_id") % 5 == 0, F.lit("never")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    t = F.coalesce(F.try_to_timestamp(text), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return e.select("event_id", F.year(t).alias("y"), F.hour(t).alias("h"))


@query("h19_project_to_ball", sql("select stop, round(2 + (x_km - 2) * least(1.0, 1.5 / greatest(d, 1e-12)), 6) as x, round(2 + (y_km - 2) * least(1.0, 1.5 / greatest(d, 1e-12)), 6) as y from (select *, sqrt((x_km - 2) ** 2 + (y_km - 2) ** 2) as d from stops)", "stops"))
def h19(spark, sf_dir):
    f = F.least(F.lit(1.0), 1.5 / F.greatest(E.distance(F.col("x_km"), F.col("y_km"), F.lit(2.0), F.lit(2.0)), F.lit(1e-12)))
    return Region(spark, sf_dir).stops().select("stop", R6(2 + (F.col("x_km") - 2) * f, "x"), R6(2 + (F.col("y_km") - 2) * f, "y"))


@query("h34_jitter", sql("select block, round(case when lo = hi then x * pow(10, 0.02 * (i - 1)) else x end, 6) as x from (select block, 1 + x_km as x, min(x_km) over (partition by x_km) as lo, max(x_km) over (partition by x_km) as hi, row_number() over (partition by x_km order by block) as i from blocks)", "blocks"))
def h34(spark, sf_dir):
    """Coincident points spread out on a log axis by their rank."""
    w = Window.partitionBy("x_km")
    i = F.row_number().over(w.orderBy("block"))
    x = 1 + F.col("x_km")
    return Region(spark, sf_dir).blocks().select("block", R6(F.when(F.min("x_km").over(w) == F.max("x_km").over(w), x * F.pow(F.lit(10.0), 0.02 * (i - 1))).otherwise(x), "x"))


@query("i5_uniform_wait", sql(f"""with s as (select route, stop, sum(secs) over (partition by route order by seq) - secs as pos, sum(secs) over (partition by route) as total, row_number() over (partition by route order by seq) as n from stops), d as (select route, pos from s where n = 1)
select s.route, round(avg({E.uniform_sql('stop', 'wait')} * 0.75), 6) as wait_h, round(avg((case when d.pos >= s.pos then d.pos - s.pos else s.total - s.pos + d.pos end) / 3600.0), 6) as transit_h, count(*)::bigint as n from s join d on s.route = d.route group by s.route""", "stops"))
def i5(spark, sf_dir):
    """Riders wait a uniform share of the headway and ride on to their route's first stop."""
    w = Window.partitionBy("route").orderBy("seq")
    s = Region(spark, sf_dir).stops().select("route", "stop", "seq", (F.sum("secs").over(w) - F.col("secs")).alias("pos"), F.sum("secs").over(Window.partitionBy("route")).alias("total"))
    goal = s.groupBy("route").agg(F.min_by("pos", "seq").alias("goal"))
    s = s.join(goal, "route")
    ride = F.when(F.col("goal") >= F.col("pos"), F.col("goal") - F.col("pos")).otherwise(F.col("total") - F.col("pos") + F.col("goal")) / 3600.0
    return s.groupBy("route").agg(R6(F.avg(E.hash_uniform(F.col("stop"), "wait") * 0.75), "wait_h"), R6(F.avg(ride), "transit_h"), F.count("*").alias("n"))


_CENTERS = ((0.25, 0.25, 0.40), (0.75, 0.25, 0.35), (0.50, 0.75, 0.25))


@query("i10_truncated_mixture", sql(f"""with u as (select i, {E.uniform_sql('i', 'k')} as k, greatest({E.uniform_sql('i', 'a')}, 1e-12) as a, {E.uniform_sql('i', 'b')} as b from (select c_custkey as i from customer)),
p as (select i, case when k < 0.40 then 0.25 when k < 0.75 then 0.75 else 0.5 end + 0.1 * sqrt(-2 * ln(a)) * cos(2 * pi() * b) as x, case when k < 0.75 then 0.25 else 0.75 end + 0.1 * sqrt(-2 * ln(a)) * sin(2 * pi() * b) as y from u),
r as (select *, row_number() over (order by i) as n from p where x between 0 and 1 and y between 0 and 1) select i, round(x, 6) as x, round(y, 6) as y from r where n <= 500"""))
def i10(spark, sf_dir):
    """Five hundred points of a mixture of Gaussians inside the unit square: more are drawn, those outside go, the first stay."""
    u = lambda salt: E.hash_uniform(F.col("id"), salt)
    r = 0.1 * F.sqrt(-2 * F.log(F.greatest(u("a"), F.lit(1e-12))))
    k = u("k")
    x = F.when(k < 0.40, _CENTERS[0][0]).when(k < 0.75, _CENTERS[1][0]).otherwise(_CENTERS[2][0]) + r * F.cos(2 * math.pi * u("b"))
    y = F.when(k < 0.75, _CENTERS[0][1]).otherwise(_CENTERS[2][1]) + r * F.sin(2 * math.pi * u("b"))
    own = Region(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"))
    p = own.select(F.col("id").alias("i"), x.alias("x"), y.alias("y")).where(F.col("x").between(0, 1) & F.col("y").between(0, 1))
    return Ordered(p, "i").running(n=F.lit(1)).where("n <= 500").select("i", R6("x", "x"), R6("y", "y"))


_KEY = "(s * 100 + block) * 100 + k"


@query("i13_scenario_metrics", sql(_RIDERS + f""", q2 as (select s, {_KEY} as id, {E.uniform_sql(_KEY, 'release')} as rel, sqrt((x - 2) ** 2 + (y - 2) ** 2) as km from rider), served as (select s, id, 0.1 as wait from q2 where km <= 1), rejected as (select s, id, 1 - rel as wait from q2 where km > 1 and km <= 2),
known as (select * from served union all select * from rejected), lost as (select s, id, 1 - rel as wait from q2 where id not in (select id from known)), every as (select *, 'known' as how from known union all select *, 'lost' from lost)
select s, count(*)::bigint as requests, count(*) filter (where how = 'lost')::bigint as unaccounted, round(avg(wait), 6) as wait_h from every group by s""", "demand", "blocks"))
def i13(spark, sf_dir):
    """Served and rejected requests, and those in neither set, which an anti join finds; means are over them all."""
    r = _requests(Region(spark, sf_dir)).select("s", ((F.col("s") * 100 + F.col("block")) * 100 + F.col("k")).alias("id"), "release_h", E.distance(F.col("x"), F.col("y"), F.lit(2.0), F.lit(2.0)).alias("km"))
    known = r.where("km <= 1").select("s", "id", F.lit(0.1).alias("wait")).union(r.where("km > 1 and km <= 2").select("s", "id", 1 - F.col("release_h")))
    lost = r.join(known.select("id"), "id", "left_anti").select("s", "id", (1 - F.col("release_h")).alias("wait"))
    every = known.withColumn("lost", F.lit(False)).union(lost.withColumn("lost", F.lit(True)))
    return every.groupBy("s").agg(F.count("*").alias("requests"), F.count_if("lost").alias("unaccounted"), R6(F.avg("wait"), "wait_h"))


_DAY_H = 12


@query("i15_daily_dispatches", sql(f"""with t as (select district, 0.5 + 0.25 * (district % 3) as T from (select distinct district from blocks)), n as (select district, T, unnest(range(ceil({_DAY_H} / T)::bigint)) as i from t),
b as (select n.district, n.i, block, x_km, y_km, {E.uniform_sql('n.i * 100 + block', 'day')} as u, coalesce(p, 0) as p, T from n join blocks using (district) left join demand using (block)),
v as (select district, i, block, x_km, y_km, T from b where u < 1 - exp(-{ARRIVALS} * p * T / 10)),
o as (select *, row_number() over (partition by district, i order by round(x_km + 10 * y_km, 9)) as k from v), w as (select district, i, T, sqrt((x_km - 2) ** 2 + (y_km - 2) ** 2) as d, coalesce(sqrt((x_km - lag(x_km) over z) ** 2 + (y_km - lag(y_km) over z) ** 2), sqrt((x_km - 2) ** 2 + (y_km - 2) ** 2)) as leg, lead(k) over z is null as last from o window z as (partition by district, i order by k)),
c as (select district, any_value(T) as T, sum(leg + case when last then d else 0 end) as km from w group by district)
select district, round(T, 6) as T, ceil({_DAY_H} / T)::bigint as dispatches, round(km, 6) as km, round(km / {_DAY_H}, 6) as km_per_h, (rank() over (order by round(km, 9) desc, district)) = 1 as worst from c""", "blocks", "demand"))
def i15(spark, sf_dir):
    """A day of twelve hours: each district's dispatches, the blocks that call in each, a tour through them row by row, and the
    district that drives most."""
    r = Region(spark, sf_dir)
    t = r.blocks().select("district").distinct().withColumn("T", 0.5 + 0.25 * (F.col("district") % 3))
    n = t.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(_DAY_H / F.col("T")) - 1)))
    b = n.join(r.blocks(), "district").join(r.demand(), "block", "left")
    calls = E.hash_uniform(F.col("i") * 100 + F.col("block"), "day") < 1 - F.exp(-ARRIVALS * F.coalesce("p", F.lit(0.0)) * F.col("T") / 10)
    z = Window.partitionBy("district", "i").orderBy(F.round(F.col("x_km") + 10 * F.col("y_km"), 9))
    home = E.distance(F.col("x_km"), F.col("y_km"), F.lit(2.0), F.lit(2.0))
    leg = F.coalesce(E.distance(F.col("x_km"), F.col("y_km"), F.lag("x_km").over(z), F.lag("y_km").over(z)), home)
    w = b.where(calls).select("district", "T", (leg + F.when(F.lead("block").over(z).isNull(), home).otherwise(0.0)).alias("km"))
    c = w.groupBy("district").agg(F.first("T").alias("T"), F.sum("km").alias("km"))
    most = c.agg(F.max_by("district", F.struct(F.round("km", 9), -F.col("district"))).alias("most"))
    return c.crossJoin(F.broadcast(most)).select("district", R6("T", "T"), F.ceil(_DAY_H / F.col("T")).alias("dispatches"), R6("km", "km"), R6(F.col("km") / _DAY_H, "km_per_h"), (F.col("district") == F.col("most")).alias("worst"))


@query("m8_deviation", sql(_Q + """, c as (select block, x_km, y_km, abs(y_km - 2) as off from blocks), v as (select q.s, c.*, q.q * 0.3 > 2 * off as go from q join c using (block) where q.q > 0),
k as (select *, row_number() over (partition by s order by x_km, y_km) as i from v where off = 0 or go), g as (select s, off, x_km, y_km, lag(x_km) over w as px, lag(y_km) over w as py from k window w as (partition by s order by i))
select s, count(*) filter (where off > 0)::bigint as deviations, round(sum(coalesce(sqrt((x_km - px) ** 2 + (y_km - py) ** 2), 0)), 6) as km from g group by s""", "demand", "blocks"))
def m8(spark, sf_dir):
    """Along the middle row a vehicle leaves its corridor for a block where the benefit exceeds the way there and back; the km
    through all that it visits, from west to east."""
    r = Region(spark, sf_dir)
    off = F.abs(F.col("y_km") - 2)
    v = scenario_demand(r).where("q > 0").join(F.broadcast(r.blocks()), "block").where((off == 0) | (F.col("q") * 0.3 > 2 * off))
    w = Window.partitionBy("s").orderBy("x_km", "y_km")
    leg = F.coalesce(E.distance(F.col("x_km"), F.col("y_km"), F.lag("x_km").over(w), F.lag("y_km").over(w)), F.lit(0.0))
    return v.select("s", off.alias("off"), leg.alias("leg")).groupBy("s").agg(F.count_if(F.col("off") > 0).alias("deviations"), R6(F.sum("leg"), "km"))


@query("o3_partition_objective", sql(TERMS_SQL + f""", t as (select *, {newton_sql("(linehaul_km + odd_cost)", "alpha", str(ARRIVALS), str(WR))} as T from terms), c as (select *, (linehaul_km + odd_cost) / T + {E.TOUR_CONSTANT} * sqrt({ARRIVALS} / T) * alpha + {WR} * alpha * sqrt(T) + {WR} * T as cost from t)
select arg_max(district, (round(cost, 9), district)) as district, round(max(cost), 6) as cost, round(arg_max(T, (round(cost, 9), district)), 6) as T from c""", *_V))
def o3(spark, sf_dir):
    """The costliest district at its own best interval."""
    t = _terms(spark, sf_dir).withColumn("T", E.dispatch_interval(F.col("linehaul_km") + F.col("odd_cost"), F.col("alpha"), F.lit(ARRIVALS), F.lit(WR)))
    cost = (F.col("linehaul_km") + F.col("odd_cost")) / F.col("T") + E.TOUR_CONSTANT * F.sqrt(ARRIVALS / F.col("T")) * F.col("alpha") + WR * F.col("alpha") * F.sqrt("T") + WR * F.col("T")
    w = t.withColumn("cost", cost).agg(F.max_by(F.struct("district", "cost", "T"), F.struct(F.round("cost", 9), "district")).alias("w"))
    return w.select("w.district", R6("w.cost", "cost"), R6("w.T", "T"))


@query("o8_partition_report", sql(TERMS_SQL + f" select district, round(2 * linehaul_km / 0.5, 6) as linehaul_per_h, round(0.25 + linehaul_km / {E.SPEED_KMH} + {E.TOUR_CONSTANT} * sqrt({ARRIVALS} * 0.5) * alpha / 2 / {E.SPEED_KMH}, 6) as rider_h from terms", *_V))
def o8(spark, sf_dir):
    t = _terms(spark, sf_dir)
    return t.select("district", R6(2 * F.col("linehaul_km") / 0.5, "linehaul_per_h"), R6(0.25 + F.col("linehaul_km") / E.SPEED_KMH + E.tour_km(F.col("alpha"), F.lit(ARRIVALS), F.lit(0.5)) / 2 / E.SPEED_KMH, "rider_h"))


@query("o17_feature_pipeline", sql("""with pop as (select c_nationkey as block, count(*)::double as pop from customer group by 1),
h as (select l_suppkey as stop, (l_partkey + l_linenumber) % 24 as hour, count(distinct l_orderkey)::double / count(distinct l_returnflag) as trips from lineitem group by all),
st as (select stop, avg(trips) as trips from h group by stop), a as (select s.stop, b.block, s.secs::double as activity, coalesce(st.trips, 0) as trips from stops s join blocks b on b.x_km = floor(s.x_km + 0.5) and b.y_km = floor(s.y_km + 0.5) left join st on st.stop = s.stop),
f as (select b.block, coalesce(any_value(pop.pop), 0) as pop, coalesce(sum(a.activity), 0) as activity, coalesce(sum(a.trips), 0) as trips from blocks b left join pop on pop.block = b.block left join a on a.block = b.block group by b.block),
m as (select min(pop) as p0, max(pop) as p1, min(activity) as a0, max(activity) as a1, min(trips) as t0, max(trips) as t1 from f),
o as (select block, case when p1 > p0 then (pop - p0) / (p1 - p0) else 0 end as p, case when a1 > a0 then (activity - a0) / (a1 - a0) else 0 end as a, case when t1 > t0 then (trips - t0) / (t1 - t0) else 0 end as t from f, m)
select block, round(case when max(p) over () > 0 then 5 * p else 2.5 end, 6) as omega1, round(case when max(a) over () > 0 or max(t) over () > 0 then 5 * (0.5 * a + 0.5 * t) else 2.5 end, 6) as omega2 from o""", "blocks", "stops"))
def o17(spark, sf_dir):
    """Features of each block from population, stop activity and trips an hour: hourly counts averaged by stop, stops dealt to
    blocks, each feature scaled to 0..1; one that is the same everywhere falls back to the middle."""
    from dispatchgrid.plans.region import minmax

    r = Region(spark, sf_dir)
    pop = r.table("customer").groupBy(F.col("c_nationkey").alias("block")).agg(F.count("*").cast("double").alias("pop"))
    h = r.table("lineitem").groupBy(F.col("l_suppkey").alias("stop"), ((F.col("l_partkey") + F.col("l_linenumber")) % 24).alias("hour")).agg((F.count_distinct("l_orderkey") / F.count_distinct("l_returnflag")).alias("trips"))
    st = h.groupBy("stop").agg(F.avg("trips").alias("trips"))
    cells = r.blocks().select("block", F.col("x_km").cast("bigint").alias("cx"), F.col("y_km").cast("bigint").alias("cy"))
    s = r.stops().select("stop", "secs", F.floor(F.col("x_km") + 0.5).alias("cx"), F.floor(F.col("y_km") + 0.5).alias("cy")).join(F.broadcast(cells), ["cx", "cy"]).join(st, "stop", "left")
    act = s.groupBy("block").agg(F.sum("secs").cast("double").alias("activity"), F.sum(F.coalesce("trips", F.lit(0.0))).alias("trips"))
    f = r.blocks().select("block").join(pop, "block", "left").join(act, "block", "left").fillna(0.0)
    o = f.select("block", minmax("pop").alias("p"), minmax("activity").alias("a"), minmax("trips").alias("t"))
    top = lambda c: F.max(c).over(Window.partitionBy()) > 0
    return o.select("block", R6(F.when(top("p"), 5 * F.col("p")).otherwise(2.5), "omega1"), R6(F.when(top("a") | top("t"), 5 * (0.5 * F.col("a") + 0.5 * F.col("t"))).otherwise(2.5), "omega2"))


_D19 = f"""{TERMS_SQL}, t as (select *, 0.5::double as T, {E.TOUR_CONSTANT} * sqrt({ARRIVALS} * 0.5) * alpha as tour from terms), m as (select greatest(sum(mass), 1e-12) as w from t)
select round(sum(linehaul_km / T), 6) as linehaul, round(sum(odd_cost / T), 6) as odd, round(sum(tour / T), 6) as travel, round(sum((2 * linehaul_km + tour) / ({E.SPEED_KMH} * T)), 6) as fleet, round(sum(mass), 6) as mass,
round(sum(mass * T) / any_value(w), 6) as T, round(sum(mass * T / 2) / any_value(w), 6) as wait, round(sum(mass * (linehaul_km + tour / 2) / {E.SPEED_KMH}) / any_value(w), 6) as ride, round(sum(mass * alpha) / any_value(w), 6) as alpha from t, m"""


@query("d19_cost_rollup", sql(_D19, *_V))
def d19(spark, sf_dir):
    """All nine sums of an evaluation in one aggregate, those of riders weighted by demand."""
    t = _terms(spark, sf_dir).withColumn("T", F.lit(0.5)).withColumn("tour", E.tour_km(F.col("alpha"), F.lit(ARRIVALS), F.lit(0.5)))
    w = F.greatest(F.sum("mass"), F.lit(1e-12))
    mean = lambda c: F.sum(F.col("mass") * c) / w
    return t.agg(
        R6(F.sum(F.col("linehaul_km") / F.col("T")), "linehaul"), R6(F.sum(F.col("odd_cost") / F.col("T")), "odd"), R6(F.sum(F.col("tour") / F.col("T")), "travel"), R6(F.sum((2 * F.col("linehaul_km") + F.col("tour")) / (E.SPEED_KMH * F.col("T"))), "fleet"), R6(F.sum("mass"), "mass"),
        R6(mean(F.col("T")), "T"), R6(mean(F.col("T") / 2), "wait"), R6(mean((F.col("linehaul_km") + F.col("tour") / 2) / E.SPEED_KMH), "ride"), R6(mean(F.col("alpha")), "alpha"),
    )


@query("s4_reference_trips", sql("select route, t as headway_h, seq, round(t + (seq - 1) * 0.05, 6) as offset_h from stops, (select unnest([0.25, 0.5, 1.0]::double[]) as t)", "stops"))
def s4(spark, sf_dir):
    s = Region(spark, sf_dir).stops().select("route", "seq", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0)))).alias("headway_h"))
    return s.select("route", "headway_h", F.col("seq").cast("bigint").alias("seq"), R6(F.col("headway_h") + (F.col("seq") - 1) * 0.05, "offset_h"))


@query("s6_insertion_positions", sql("select user_id, i::int as position, list_aggregate(list_concat(list_concat(e[:i], ['x']), e[i + 1:]), 'string_agg', ',') as events from (select user_id, list(event_id::varchar order by event_id) as e from events where event_type = 'purchase' group by user_id), unnest(range(len(e) + 1)) as u(i)"))
def s6(spark, sf_dir):
    """A request put at every place of an event list."""
    e = Region(spark, sf_dir).table("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("e"))
    e = e.select("user_id", F.transform("e", lambda x: x.cast("string")).alias("e")).select("user_id", "e", F.explode(F.sequence(F.lit(0), F.size("e"))).alias("position"))
    return e.select("user_id", "position", F.array_join(F.array_insert("e", F.col("position") + 1, F.lit("x")), ",").alias("events"))


@query("s11_bound_gap", sql("with t as (select district, sum(sqrt(coalesce(p, 0))) as a, sum(coalesce(p, 0)) as m, sum(area_km2) as area from blocks left join demand using (block) group by district) select arg_max(district, (round(m * area / nullif(a * a, 0), 9), district)) as district, round(max(m * area / nullif(a * a, 0)), 6) as ratio from t", "blocks", "demand"))
def s11(spark, sf_dir):
    """Upper over lower bound of the tour coefficient at radius 0, and the district where they are furthest apart."""
    r = Region(spark, sf_dir)
    p = F.coalesce("p", F.lit(0.0))
    t = r.blocks().join(r.demand(), "block", "left").groupBy("district").agg(F.sum(F.sqrt(p)).alias("a"), F.sum(p).alias("m"), F.sum("area_km2").alias("area"))
    ratio = F.col("m") * F.col("area") / F.nullif(F.col("a") * F.col("a"), F.lit(0.0))
    return t.agg(F.max_by("district", F.struct(F.round(ratio, 9), "district")).alias("district"), R6(F.max(ratio), "ratio"))


_BETA = f"list_sort([{', '.join(E.uniform_sql('i', f'b{k}') for k in range(6))}])[2]"
_NORM = f"least(1.0, greatest(0.0, 0.5 + 0.2 * sqrt(-2 * ln(greatest({E.uniform_sql('i', 'na')}, 1e-12))) * cos(2 * pi() * {E.uniform_sql('i', 'nb')})))"


@query("s24_unit_square_densities", sql(f"with d as (select {E.uniform_sql('i', 'u')} as u, {_BETA} as b, {_NORM} as n from (select o_orderkey as i from orders)) select round(avg(u), 6) as uniform_mean, round(avg(b), 6) as beta_mean, round(avg(30 * b * pow(1 - b, 4)), 6) as beta_density, round(avg(n), 6) as normal_mean, count(*) filter (where n = 0 or n = 1)::bigint as clipped from d"))
def s24(spark, sf_dir):
    """Uniform, Beta(2, 5) (the second of six uniforms) and clipped normal draws, and the Beta density at its own draws."""
    u = lambda salt: E.hash_uniform(F.col("id"), salt)
    beta = F.get(F.array_sort(F.array(*(u(f"b{k}") for k in range(6)))), F.lit(1))
    normal = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.2 * F.sqrt(-2 * F.log(F.greatest(u("na"), F.lit(1e-12)))) * F.cos(2 * math.pi * u("nb"))))
    d = Region(spark, sf_dir).table("orders").select(F.col("o_orderkey").alias("id")).select(u("u").alias("u"), beta.alias("b"), normal.alias("n"))
    return d.agg(R6(F.avg("u"), "uniform_mean"), R6(F.avg("b"), "beta_mean"), R6(F.avg(30 * F.col("b") * F.pow(1 - F.col("b"), 4)), "beta_density"), R6(F.avg("n"), "normal_mean"), F.count_if((F.col("n") == 0) | (F.col("n") == 1)).alias("clipped"))


@query("s12_speed_units", sql(f"select l_linenumber, round(avg(l_quantity) / {E.KM_PER_MILE}, 6) as mph from lineitem group by 1"))
def s12(spark, sf_dir):
    return Region(spark, sf_dir).table("lineitem").groupBy("l_linenumber").agg(R6(F.avg("l_quantity") / E.KM_PER_MILE, "mph"))


@query("s14_listed_order", sql("select n_nationkey as block, row_number() over (order by n_name)::int as place from nation"))
def s14(spark, sf_dir):
    n = Region(spark, sf_dir).table("nation")
    return n.select(F.col("n_nationkey").alias("block"), F.row_number().over(Window.orderBy("n_name")).alias("place"))


