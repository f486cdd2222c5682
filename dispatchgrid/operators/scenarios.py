"""Scenario simulation with common random numbers drawn from hashes, so that every candidate sees the same draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.distributions import poisson_quantile
from dispatchgrid.functions.exprs import SPEED_KMH, distance, hash_uniform, uniform_sql
from dispatchgrid.functions.ordered import Ordered
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)
#: Terms that the SQL of small means sums; the means of a block are below 6.
SCENARIOS, MOST = 20, 60


#: The same quantile in SQL: how many of the running probabilities stay below u.
_PMF = f"pm as (select block, k, sum(exp(-m + k * ln(m) - lgamma(k + 1.0))) over (partition by block order by k) as cdf, m from (select block, 6.0 * p as m from demand), (select unnest(range({MOST})) as k))"
_U = uniform_sql("s * 100 + block", "demand")
_Q = f"""with {_PMF}, sc as (select s::bigint as s, block, {_U} as u from demand, (select unnest(range({SCENARIOS})) as s)),
q as (select s, sc.block, count(*) filter (where u > cdf) as q from sc join pm on pm.block = sc.block group by all)"""


def scenario_demand(r: Region, n: int = SCENARIOS) -> DataFrame:
    """s, block, q: integer demand of each scenario and block."""
    s = r.spark.range(n).withColumnRenamed("id", "s")
    x = r.demand().crossJoin(s)
    return x.select("s", "block", poisson_quantile(6.0 * F.col("p"), hash_uniform(F.col("s") * 100 + F.col("block"), "demand")).alias("q"))


@query("h29_poisson_quantile", sql(_Q + " select s, block, q::int as q from q", "demand"))
def h29(spark, sf_dir):
    return scenario_demand(Region(spark, sf_dir))


@query("h29_quantiles_of_any_mean", """with m as (select user_id % 25 as block, count(*)::double as mean from events group by 1), u as (select unnest([0.025, 0.5, 0.975])::double as u),
c as (select block, mean, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1.0))) over (partition by block order by k) as cdf from (select block, mean, unnest(range((mean + 9 * sqrt(mean) + 40)::bigint)) as k from m))
select block, mean::bigint as mean, round(u, 3) as u, min(k)::int as k from c, u where cdf >= u group by all""")
def h29_any_mean(spark, sf_dir):
    """Bounds and middle of the counts that each block's number of events would have as a Poisson mean, be it ten or a million."""
    m = Region(spark, sf_dir).table("events").groupBy((F.col("user_id") % 25).alias("block")).agg(F.count("*").alias("mean"))
    m = m.select("block", "mean", F.explode(F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("u"))
    return m.select("block", "mean", "u", poisson_quantile(F.col("mean").cast("double"), F.col("u")).alias("k"))


@query("i6_district_scenarios", sql(_Q + " select s, district, sum(q)::bigint as q from q join blocks using (block) group by all", "demand", "blocks"))
def i6(spark, sf_dir):
    r = Region(spark, sf_dir)
    return scenario_demand(r).join(r.blocks().select("block", "district"), "block").groupBy("s", "district").agg(F.sum("q").alias("q"))


@query("i8_active_locations", sql(_Q + " select s, count(*)::bigint as active, sum(q)::bigint as q from q where q > 0 group by s", "demand"))
def i8(spark, sf_dir):
    return scenario_demand(Region(spark, sf_dir)).where("q > 0").groupBy("s").agg(F.count("*").alias("active"), F.sum("q").alias("q"))


def crn(r: Region, n: int = SCENARIOS) -> DataFrame:
    s = r.spark.range(n).withColumnRenamed("id", "s")
    u = hash_uniform(F.col("s") * 100 + F.col("block"), "crn")
    return r.blocks().crossJoin(s).select("s", "block", F.least(F.greatest(u, F.lit(0.0)), F.lit(1 - 1e-10)).alias("u"))


@query("i14_common_uniforms", sql(f"select s, block, round(least(greatest({uniform_sql('s * 100 + block', 'crn')}, 0), 1 - 1e-10), 9) as u from blocks, (select unnest(range({SCENARIOS})) as s)", "blocks"))
def i14(spark, sf_dir):
    return crn(Region(spark, sf_dir)).select("s", "block", F.round("u", 9).alias("u"))


_ARRIVALS = "select event_id, user_id % 25 as block, (epoch_us(ts) - epoch_us(timestamp '2024-01-01'))::double / 3.6e9 as t_h from events"


def arrivals(r: Region) -> DataFrame:
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3.6e9
    return r.table("events").select("event_id", (F.col("user_id") % 25).alias("block"), t.alias("t_h"))


@query("i1_dispatch_batches", sql(f"select floor(t_h / 0.5)::bigint as batch, count(*)::bigint as riders, round(avg((floor(t_h / 0.5) + 1) * 0.5 - t_h), 6) as mean_wait from ({_ARRIVALS}) group by 1"))
def i1(spark, sf_dir):
    """Riders wait for the end of the half-hour window they arrive in."""
    a = arrivals(Region(spark, sf_dir)).withColumn("batch", F.floor(F.col("t_h") / 0.5))
    return a.groupBy("batch").agg(F.count("*").alias("riders"), R6(F.avg((F.col("batch") + 1) * 0.5 - F.col("t_h")), "mean_wait"))


@query("i9_rider_positions", sql(_Q + f""", r as (select s, block, k, sqrt({uniform_sql('(s * 100 + block) * 100 + k', 'radius')}) * sqrt(1 / pi()) as r, 2 * pi() * {uniform_sql('(s * 100 + block) * 100 + k', 'angle')} as a from (select s, block, unnest(range(1, q + 1)) as k from q))
select s, block, k::int as k, round(x_km + r * cos(a), 6) as x, round(y_km + r * sin(a), 6) as y from r join blocks using (block)""", "demand", "blocks"))
def i9(spark, sf_dir):
    """Riders uniform in the disk of their block's area."""
    return riders(Region(spark, sf_dir)).select("s", "block", "k", R6("x", "x"), R6("y", "y"))


def riders(r: Region) -> DataFrame:
    q = scenario_demand(r).where("q > 0").select("s", "block", F.explode(F.sequence(F.lit(1), F.col("q"))).alias("k"))
    key = (F.col("s") * 100 + F.col("block")) * 100 + F.col("k")
    rad, ang = F.sqrt(hash_uniform(key, "radius")) * F.sqrt(F.col("area_km2") / math.pi), 2 * math.pi * hash_uniform(key, "angle")
    return q.join(F.broadcast(r.blocks()), "block").select("s", "block", "k", (F.col("x_km") + rad * F.cos(ang)).alias("x"), (F.col("y_km") + rad * F.sin(ang)).alias("y"))


_RIDERS = _Q + f""", r as (select s, block, k, sqrt({uniform_sql('(s * 100 + block) * 100 + k', 'radius')}) * sqrt(1 / pi()) as r, 2 * pi() * {uniform_sql('(s * 100 + block) * 100 + k', 'angle')} as a from (select s, block, unnest(range(1, q + 1)) as k from q)),
rider as (select s, block, k, x_km + r * cos(a) as x, y_km + r * sin(a) as y from r join blocks using (block))"""


@query("c16_nearest_service_point", sql(_RIDERS + """, c as (select block as site, x_km as sx, y_km as sy from blocks where block % 2 = 0)
select s, block, k::int as k, arg_min(site, (round(sqrt((x - sx) ** 2 + (y - sy) ** 2), 9), site)) as site, round(min(sqrt((x - sx) ** 2 + (y - sy) ** 2)), 6) as km from rider, c group by all""".replace("group by all", "group by s, block, k"), "demand", "blocks"))
def c16(spark, sf_dir):
    """Each rider to the nearest candidate service point; candidates are the region's and are broadcast."""
    r = Region(spark, sf_dir)
    c = r.blocks().where("block % 2 = 0").select(F.col("block").alias("site"), F.col("x_km").alias("sx"), F.col("y_km").alias("sy"))
    km = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    return riders(r).crossJoin(F.broadcast(c)).groupBy("s", "block", "k").agg(F.min_by("site", F.struct(F.round(km, 9), "site")).alias("site"), R6(F.min(km), "km"))


@query("c19_outcomes", sql(_RIDERS + """, c as (select block as site, x_km as sx, y_km as sy, block % 4 <> 2 as served from blocks where block % 2 = 0),
n as (select s, block, k, arg_min(site, (round(sqrt((x - sx) ** 2 + (y - sy) ** 2), 9), site)) as site, min(sqrt((x - sx) ** 2 + (y - sy) ** 2)) as km from rider, c group by s, block, k)
select s, count(*) filter (where km > 1)::bigint as too_far, count(*) filter (where km <= 1 and site % 4 <> 2)::bigint as served, count(*) filter (where km <= 1 and site % 4 = 2)::bigint as reassigned from n group by s""", "demand", "blocks"))
def c19(spark, sf_dir):
    r = Region(spark, sf_dir)
    c = r.blocks().where("block % 2 = 0").select(F.col("block").alias("site"), F.col("x_km").alias("sx"), F.col("y_km").alias("sy"))
    km = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))
    n = riders(r).crossJoin(F.broadcast(c)).groupBy("s", "block", "k").agg(F.min_by("site", F.struct(F.round(km, 9), "site")).alias("site"), F.min(km).alias("km"))
    far, open_ = F.col("km") > 1, F.col("site") % 4 != 2
    return n.groupBy("s").agg(F.count_if(far).alias("too_far"), F.count_if(~far & open_).alias("served"), F.count_if(~far & ~open_).alias("reassigned"))


@query("d30_outcome_counts", sql(_Q + " select block, sum(case when q > 0 then q else 0 end)::bigint as requests, count(*) filter (where q = 0)::bigint as empty from q group by block", "demand"))
def d30(spark, sf_dir):
    return scenario_demand(Region(spark, sf_dir)).groupBy("block").agg(F.sum("q").alias("requests"), F.count_if(F.col("q") == 0).alias("empty"))


@query("d23_scenario_means", sql(_Q + ", t as (select s, sum(q) as n, sum(q * q) as q2 from q group by s) select round(avg(n), 6) as mean_n, ceil(avg(n))::bigint as vehicles, round(avg(q2), 6) as mean_q2 from t", "demand"))
def d23(spark, sf_dir):
    t = scenario_demand(Region(spark, sf_dir)).groupBy("s").agg(F.sum("q").alias("n"), F.sum(F.col("q") * F.col("q")).alias("q2"))
    return t.agg(R6(F.avg("n"), "mean_n"), F.ceil(F.avg("n")).alias("vehicles"), R6(F.avg("q2"), "mean_q2"))


def queue_wait(times: Column, service: Column, servers: int) -> Column:
    """Total wait of first-come service by `servers` vehicles: a fold over arrivals in order, the free times kept sorted."""
    start = F.struct(F.array_repeat(F.lit(0.0), servers).alias("free"), F.lit(0.0).alias("wait"))

    def step(a: Column, t: Column) -> Column:
        begin = F.greatest(t, F.get(a["free"], F.lit(0)))
        rest = F.slice(a["free"], F.lit(2), F.lit(servers - 1)) if servers > 1 else F.array().cast("array<double>")
        return F.struct(F.array_sort(F.concat(rest, F.array(begin + service))).alias("free"), (a["wait"] + begin - t).alias("wait"))

    return F.aggregate(times, start, step)["wait"]


@query("i2_fleet_queue", sql(f"""with a as (select floor(t_h / 6)::bigint as s, t_h - 6 * floor(t_h / 6) as t, event_id, row_number() over (partition by floor(t_h / 6)::bigint order by t_h, event_id) as i from ({_ARRIVALS})),
f as (select s, i, t, [0.0::double, t + 0.03] as free, 0.0::double as wait from a where i = 1 union all
select a.s, a.i, a.t, list_sort([f.free[2], greatest(a.t, f.free[1]) + 0.03]), f.wait + greatest(a.t, f.free[1]) - a.t from f join a on a.s = f.s and a.i = f.i + 1)
select s, round(max(wait), 6) as total_wait, max(i)::bigint as n from f group by s""", recursive=False).replace("with a as", "with recursive a as", 1))
def i2(spark, sf_dir):
    """Two vehicles, constant service of 0.03 h, each six-hour scenario on its own."""
    a = arrivals(Region(spark, sf_dir)).withColumn("s", F.floor(F.col("t_h") / 6))
    g = a.groupBy("s").agg(F.array_sort(F.collect_list(F.col("t_h") - 6 * F.col("s"))).alias("times"))
    return g.select("s", R6(queue_wait(F.col("times"), F.lit(0.03), 2), "total_wait"), F.size("times").cast("bigint").alias("n"))


@query("i3_shared_arrivals", sql(f"select floor(t_h / 6)::bigint as s, count(*)::bigint as n, round(sum(km), 6) as km from (select t_h, sqrt((x_km - 2) ** 2 + (y_km - 2) ** 2) as km from ({_ARRIVALS}) a join blocks b on a.block = b.block) group by 1", "blocks"))
def i3(spark, sf_dir):
    r = Region(spark, sf_dir)
    a = arrivals(r).join(F.broadcast(r.blocks()), "block")
    km = distance(F.col("x_km"), F.col("y_km"), F.lit(2.0), F.lit(2.0))
    return a.groupBy(F.floor(F.col("t_h") / 6).alias("s")).agg(F.count("*").alias("n"), R6(F.sum(km), "km"))


@query("i4_next_bus", sql(f"""with b as (select block, 0.05 * block as first from blocks)
select a.event_id, round(first + ceil(greatest(t_h - first, 0) / 0.75) * 0.75 - t_h, 6) as wait_h from ({_ARRIVALS}) a join b on a.block = b.block""", "blocks"))
def i4(spark, sf_dir):
    """The next visit of a bus that passes a stop every 45 minutes: an as-of look-up that the timetable answers in closed form."""
    a = arrivals(Region(spark, sf_dir)).withColumn("first", 0.05 * F.col("block"))
    visit = F.col("first") + F.ceil(F.greatest(F.col("t_h") - F.col("first"), F.lit(0.0)) / 0.75) * 0.75
    return a.select("event_id", R6(visit - F.col("t_h"), "wait_h"))


@query("i4_next_visit", """with e as (select event_id, user_id % 25 as stop, ts, event_type = 'purchase' as visit from events)
select event_id, stop, (select epoch_us(min(v.ts)) from e v where v.visit and v.stop = a.stop and v.ts >= a.ts) - epoch_us(ts) as wait_us from e a where not visit""")
def i4_next_visit(spark, sf_dir):
    """The wait of each rider until the next visit of an uneven timetable: riders and visits in one order of stop and time, the
    next visit carried over the edges of partitions, so that a busy stop is dealt over several. Null after the last visit."""
    e = Region(spark, sf_dir).table("events").select("event_id", (F.col("user_id") % 25).alias("stop"), F.col("ts"), (F.col("event_type") == "purchase").alias("visit"))
    seen = Ordered(e.withColumn("rider", ~F.col("visit")), "stop", "ts", "rider", "event_id").next_seen("next", F.when(F.col("visit"), F.struct("stop", "ts")))
    wait = F.when(F.col("next.stop") == F.col("stop"), F.unix_micros(F.col("next.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    return seen.where("not visit").select("event_id", "stop", wait.alias("wait_us"))


@query("i11_request_batch", sql(_RIDERS + f" select s, block, k::int as k, round({uniform_sql('(s * 100 + block) * 100 + k', 'release')}, 6) as release_h, round({uniform_sql('(s * 100 + block) * 100 + k', 'release')} + sqrt((x - 2) ** 2 + (y - 2) ** 2) / {SPEED_KMH} + 0.25, 6) as deadline_h from rider", "demand", "blocks"))
def i11(spark, sf_dir):
    return _requests(Region(spark, sf_dir)).select("s", "block", "k", R6("release_h", "release_h"), R6("deadline_h", "deadline_h"))


def _requests(r: Region) -> DataFrame:
    release = hash_uniform((F.col("s") * 100 + F.col("block")) * 100 + F.col("k"), "release")
    return riders(r).select("*", release.alias("release_h")).withColumn("deadline_h", F.col("release_h") + distance(F.col("x"), F.col("y"), F.lit(2.0), F.lit(2.0)) / SPEED_KMH + 0.25)


@query("i12_overflow_metrics", sql(_RIDERS + f" select s, round(avg(1.0 - {uniform_sql('(s * 100 + block) * 100 + k', 'release')}), 6) as wait_h, round(sum(2 * sqrt((x - 2) ** 2 + (y - 2) ** 2)), 6) as km from rider group by s", "demand", "blocks"))
def i12(spark, sf_dir):
    """Requests served outside the schedule: they wait to the horizon and cost a round trip each."""
    return _requests(Region(spark, sf_dir)).groupBy("s").agg(R6(F.avg(1.0 - F.col("release_h")), "wait_h"), R6(F.sum(2 * distance(F.col("x"), F.col("y"), F.lit(2.0), F.lit(2.0))), "km"))


@query("i17_service_level", sql(f"select min(v)::int as vehicles from (select v, avg(case when 1.2 * (0.5 + {uniform_sql('i', 'tour')}) / {SPEED_KMH} * 100 <= v then 1.0 else 0.0 end) as level from (select o_orderkey as i from orders), (select unnest(range(1, 21)) as v) group by v) where level >= 0.95"))
def i17(spark, sf_dir):
    """The fewest vehicles that finish in time in 95 of 100 scenarios."""
    tours = Region(spark, sf_dir).table("orders").select((1.2 * (0.5 + hash_uniform(F.col("o_orderkey"), "tour")) / SPEED_KMH * 100).alias("need"))
    v = tours.select("need", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("v"))
    level = v.groupBy("v").agg(F.avg(F.when(F.col("need") <= F.col("v"), 1.0).otherwise(0.0)).alias("level"))
    return level.where("level >= 0.95").agg(F.min("v").alias("vehicles"))


@query("i7_cell_sampling", sql(f"""with c as (select block, sum(p) over (order by block) as hi, sum(p) over (order by block) - p as lo, x_km, y_km from demand join blocks using (block)), u as (select i, {uniform_sql('i', 'cell')} as u, {uniform_sql('i', 'jx')} as jx, {uniform_sql('i', 'jy')} as jy from (select unnest(range(1000)) as i))
select i, block, round(x_km + jx, 6) as x, round(y_km + jy, 6) as y from u join c on u >= lo and u < hi""", "demand", "blocks"))
def i7(spark, sf_dir):
    """Locations drawn by cell mass and jittered inside the cell; the cumulative masses are the region's and are broadcast."""
    r = Region(spark, sf_dir)
    c = Ordered(r.demand().join(r.blocks(), "block"), "block").running(hi=F.col("p")).select("block", "hi", (F.col("hi") - F.col("p")).alias("lo"), "x_km", "y_km")
    u = spark.range(1000).select(F.col("id").alias("i"), hash_uniform(F.col("id"), "cell").alias("u"), hash_uniform(F.col("id"), "jx").alias("jx"), hash_uniform(F.col("id"), "jy").alias("jy"))
    return u.join(F.broadcast(c), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("i", "block", R6(F.col("x_km") + F.col("jx"), "x"), R6(F.col("y_km") + F.col("jy"), "y"))
