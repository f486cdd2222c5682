"""Unions, intersections, differences, distinct rows and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import distance
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


@query("g1_union_by_name", sql("select s_suppkey as id, s_acctbal as balance, null as segment from supplier union all select c_custkey, c_acctbal, c_mktsegment from customer"))
def g1(spark, sf_dir):
    r = Region(spark, sf_dir)
    s = r.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("g2_three_way_intersection", sql("select l_suppkey as stop from lineitem where l_returnflag = 'A' intersect select l_suppkey from lineitem where l_returnflag = 'N' intersect select l_suppkey from lineitem where l_returnflag = 'R'"))
def g2(spark, sf_dir):
    t = Region(spark, sf_dir).table("lineitem")
    of = lambda f: t.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("stop"))
    return of("A").intersect(of("N")).intersect(of("R"))


@query("g3_difference", sql("select block from blocks where block not in (select s_nationkey from supplier where s_acctbal < 0)", "blocks"))
def g3(spark, sf_dir):
    r = Region(spark, sf_dir)
    return r.blocks().select("block").join(r.table("supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("block")), "block", "left_anti")


@query("g4_distinct_on_key", sql("select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey"))
def g4(spark, sf_dir):
    """The first row of each key; first is the smallest order key."""
    return Region(spark, sf_dir).table("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("g5_distinct_settings", sql("select distinct l_linenumber as setting, l_returnflag as mode from lineitem"))
def g5(spark, sf_dir):
    return Region(spark, sf_dir).table("lineitem").select(F.col("l_linenumber").alias("setting"), F.col("l_returnflag").alias("mode")).distinct()


@query("g6_available_and_missing", sql("select id::bigint as id, exists (select 1 from customer where c_custkey = id) as available from (select unnest(range(0, 3000, 7)) as id)"))
def g6(spark, sf_dir):
    c = Region(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("got"))
    return spark.range(0, 3000, 7).join(c, "id", "left").select("id", F.coalesce("got", F.lit(False)).alias("available"))


@query("g7_candidate_fleets", sql("with k as (select distinct l_linenumber as k from lineitem) select distinct f::bigint as fleet from (select a.k * b.k as f from k a, k b union select a.k * b.k + a.k from k a, k b) where f between 1 and 20"))
def g7(spark, sf_dir):
    k = Region(spark, sf_dir).table("lineitem").select(F.col("l_linenumber").cast("long").alias("k")).distinct()
    k = k.crossJoin(F.broadcast(k.withColumnRenamed("k", "d")))  # line numbers are a handful
    return k.select((F.col("k") * F.col("d")).alias("fleet")).union(k.select(F.col("k") * F.col("d") + F.col("k"))).where("fleet between 1 and 20").distinct()


_SIDES = "select district, dx, dy, x_km + ex as x, y_km + ey as y from blocks, (values (1, 0, 0, 0), (1, 0, 0, 1), (0, 1, 0, 0), (0, 1, 1, 0)) s(dx, dy, ex, ey)"


@query("g8_union_boundary", sql(f"select district, count(*)::bigint as boundary_sides from (select district, dx, dy, x, y from ({_SIDES}) group by all having count(*) = 1) group by district", "blocks"))
def g8(spark, sf_dir):
    """Outline of each district: the sides of its unit squares that occur once."""
    sides = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("ex"), F.lit(d).alias("ey")) for a, b, c, d in ((1, 0, 0, 0), (1, 0, 0, 1), (0, 1, 0, 0), (0, 1, 1, 0)))))
    s = Region(spark, sf_dir).blocks().select("district", "x_km", "y_km", sides.alias("s")).select("district", "s.dx", "s.dy", (F.col("x_km") + F.col("s.ex")).alias("x"), (F.col("y_km") + F.col("s.ey")).alias("y"))
    once = s.groupBy("district", "dx", "dy", "x", "y").count().where("count = 1")
    return once.groupBy("district").agg(F.count("*").alias("boundary_sides"))


@query("f1_centermost", sql("select block, round(d, 6) as d from (select block, sqrt((x_km - avg(x_km) over ()) ** 2 + (y_km - avg(y_km) over ()) ** 2) as d from blocks) order by round(d, 9), block limit 9", "blocks"))
def f1(spark, sf_dir):
    """The nine blocks nearest to the mean position; the limit is the operator."""
    m = Window.partitionBy()
    d = distance(F.col("x_km"), F.col("y_km"), F.avg("x_km").over(m), F.avg("y_km").over(m))
    return Region(spark, sf_dir).blocks().select("block", d.alias("d")).orderBy(F.round("d", 9), "block").limit(9).select("block", R6("d", "d"))


@query("f2_default_depot", sql("select depot from depot", "depot"))
def f2(spark, sf_dir):
    return Region(spark, sf_dir).depot()


MEDOID_SQL = "select district, arg_min(block, (round(sqrt((x_km - mx) ** 2 + (y_km - my) ** 2), 9), block)) as root from (select *, avg(x_km) over (partition by district) as mx, avg(y_km) over (partition by district) as my from blocks) group by district"


@query("f3_medoids", sql(MEDOID_SQL, "blocks"))
def f3(spark, sf_dir):
    w = Window.partitionBy("district")
    d = distance(F.col("x_km"), F.col("y_km"), F.avg("x_km").over(w), F.avg("y_km").over(w))
    return Region(spark, sf_dir).blocks().withColumn("d", F.round(d, 9)).groupBy("district").agg(F.min_by("block", F.struct("d", "block")).alias("root"))


@query("f4_one_median", sql("select district, arg_min(src, (round(s, 9), src)) as center, round(min(s), 6) as total_km from (select a.district, src, sum(km) as s from dist join blocks a on a.block = src join blocks b on b.block = dst and b.district = a.district group by a.district, src) group by district", "blocks", "dist"))
def f4(spark, sf_dir):
    r = Region(spark, sf_dir)
    a, b = r.blocks().select(F.col("block").alias("src"), "district"), r.blocks().select(F.col("block").alias("dst"), "district")
    s = a.join(b, "district").join(r.distances(), ["src", "dst"]).groupBy("district", "src").agg(F.sum("km").alias("s"))
    return s.groupBy("district").agg(F.min_by("src", F.struct(F.round("s", 9), "src")).alias("center"), R6(F.min("s"), "total_km"))


@query("f5_best_depot", sql("""with m as (select district, sum(coalesce(p, 0)) as mass from blocks left join demand using (block) group by district), n as (select src as cand, district, min(km) as km from dist join blocks on block = dst group by src, district), c as (select cand, sum(mass * km) as cost from n join m using (district) group by cand)
select arg_min(cand, (round(cost, 9), cand)) as depot, round(min(cost), 6) as cost from c""", "blocks", "demand", "dist"))
def f5(spark, sf_dir):
    """The block from which the mass-weighted way to the nearest block of each district is shortest."""
    r = Region(spark, sf_dir)
    b = r.blocks().select(F.col("block").alias("dst"), "district")
    mass = r.blocks().join(r.demand(), "block", "left").groupBy("district").agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("mass"))
    near = r.distances().join(b, "dst").groupBy(F.col("src").alias("cand"), "district").agg(F.min("km").alias("km"))
    c = near.join(mass, "district").groupBy("cand").agg(F.sum(F.col("mass") * F.col("km")).alias("cost"))
    return c.agg(F.min_by("cand", F.struct(F.round("cost", 9), "cand")).alias("depot"), R6(F.min("cost"), "cost"))


@query("f6_root_relocation", sql("select district, arg_min(block, (round(km, 9), block)) as root from blocks join dist on dst = block join depot on src = depot group by district", "blocks", "dist", "depot"))
def f6(spark, sf_dir):
    r = Region(spark, sf_dir)
    d = r.distances().join(F.broadcast(r.depot()), F.col("src") == F.col("depot")).select(F.col("dst").alias("block"), "km")
    return r.blocks().join(d, "block").groupBy("district").agg(F.min_by("block", F.struct(F.round("km", 9), "block")).alias("root"))


@query("f9_top_six", sql("select route, stop, rank::int as rank from (select route, stop, row_number() over (partition by route order by round(sqrt((x_km - 2.5) ** 2 + (y_km - 2.5) ** 2), 9), stop) as rank from stops) where rank <= 6", "stops"))
def f9(spark, sf_dir):
    """The six stops of each route nearest to the middle."""
    w = Window.partitionBy("route").orderBy(F.round(distance(F.col("x_km"), F.col("y_km"), F.lit(2.5), F.lit(2.5)), 9), "stop")
    return Region(spark, sf_dir).stops().select("route", "stop", F.row_number().over(w).alias("rank")).where("rank <= 6")


@query("f11_newest", sql("select user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id"))
def f11(spark, sf_dir):
    return Region(spark, sf_dir).table("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("f12_latest_qualifying", sql("select max(day) as day from (select ts::date as day, count(distinct event_type) as n from events group by 1 having count(distinct event_type) >= 3)"))
def f12(spark, sf_dir):
    d = Region(spark, sf_dir).table("events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("event_type").alias("n"))
    return d.where("n >= 3").agg(F.max("day").alias("day"))


@query("f14_ordered_requests", sql("select user_id, string_agg(event_id::varchar, ',' order by ts, event_id) as requests from events where event_type = 'purchase' group by user_id"))
def f14(spark, sf_dir):
    e = Region(spark, sf_dir).table("events").where("event_type = 'purchase'")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
    return e.groupBy("user_id").agg(F.array_join(ids, ",").alias("requests"))
