"""Window functions: running sums, lags, ranks and ordered folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import distance
from dispatchgrid.functions.ordered import Ordered, packed_in_order
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


@query("e1_two_target_cut", sql("""with r as (select block, sum(coalesce(p, 0)) over (order by x_km * 0.8 + y_km * 0.6 desc, block rows unbounded preceding) as mass, count(*) over (order by x_km * 0.8 + y_km * 0.6 desc, block rows unbounded preceding) as area from blocks left join demand using (block))
select arg_min(block, (round(abs(mass - 0.5) + abs(area / every - 0.5), 9), area)) as block, round(min(abs(mass - 0.5) + abs(area / every - 0.5)), 6) as error from r, (select count(*)::double as every from blocks)""", "blocks", "demand"))
def e1(spark, sf_dir):
    """The place along a direction where running mass and running area come nearest to their shares."""
    r = Region(spark, sf_dir)
    b = r.blocks().join(r.demand(), "block", "left").select("block", (-(F.col("x_km") * 0.8 + F.col("y_km") * 0.6)).alias("along"), F.coalesce("p", F.lit(0.0)).alias("p"))
    b = Ordered(b, "along", "block").running(mass=F.col("p"), area=F.lit(1))
    error = F.abs(F.col("mass") - 0.5) + F.abs(F.col("area") / float(r.blocks().count()) - 0.5)
    return b.agg(F.min_by("block", F.struct(F.round(error, 9), "area")).alias("block"), R6(F.min(error), "error"))


@query("e2_sliver_cuts", sql("""with g as (select x_km as x, sum(coalesce(p, 0)) as m from blocks left join demand using (block) group by x_km), c as (select x, sum(m) over (order by x) as cum, lead(x) over (order by x) as nx from g)
select k, min((x + coalesce(nx, x)) / 2) as cut from c, (select unnest(range(1, 4)) as k) where cum >= k / 4.0 - 1e-12 group by k""", "blocks", "demand"))
def e2(spark, sf_dir):
    r = Region(spark, sf_dir)
    g = r.blocks().join(r.demand(), "block", "left").groupBy(F.col("x_km").alias("x")).agg(F.sum(F.coalesce("p", F.lit(0.0))).alias("m"))
    c = Ordered(Ordered(g, "x").running(cum=F.col("m")), "x").next_seen("nx", F.col("x"), itself=False).select("cum", "x", "nx", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    return c.where(F.col("cum") >= F.col("k") / 4.0 - 1e-12).groupBy("k").agg(F.min((F.col("x") + F.coalesce("nx", "x")) / 2).alias("cut"))


@query("e3_capacity_truncation", sql("""with o as (select o_custkey % 25 as block, o_orderkey as loc, o_totalprice as q from orders), c as (select block, loc, q, sum(q) over (partition by block order by q desc, loc rows unbounded preceding) - q as before from o)
select block, count(*)::bigint as kept, round(sum(q), 2) as load from c where before <= 1500000 group by block"""))
def e3(spark, sf_dir):
    """Largest first until the capacity is passed, the location that passes it included."""
    o = Region(spark, sf_dir).table("orders").select((F.col("o_custkey") % 25).alias("block"), F.col("o_orderkey").alias("loc"), F.col("o_totalprice").alias("q"))
    w = Window.partitionBy("block").orderBy(F.desc("q"), "loc").rowsBetween(Window.unboundedPreceding, 0)
    kept = o.withColumn("before", F.sum("q").over(w) - F.col("q")).where("before <= 1500000")
    return kept.groupBy("block").agg(F.count("*").alias("kept"), F.round(F.sum("q"), 2).alias("load"))


@query("e4_cyclic_transit", sql("""with s as (select route, stop, seq, sum(secs) over (partition by route order by seq) - secs as pos, sum(secs) over (partition by route) as total from stops), d as (select route, pos from s where seq = 3)
select s.route, s.stop, (case when d.pos >= s.pos then d.pos - s.pos else s.total - s.pos + d.pos end)::bigint as secs from s join d on s.route = d.route""", "stops"))
def e4(spark, sf_dir):
    """Seconds from each stop along its route to the route's third stop, past the end and on where needed."""
    w = Window.partitionBy("route")
    s = Region(spark, sf_dir).stops().select("route", "stop", "seq", (F.sum("secs").over(w.orderBy("seq")) - F.col("secs")).alias("at"), F.sum("secs").over(w).alias("total"))
    d = F.max(F.when(F.col("seq") == 3, F.col("at"))).over(w)
    s = s.withColumn("d", d).where("d is not null")
    return s.select("route", "stop", F.when(F.col("d") >= F.col("at"), F.col("d") - F.col("at")).otherwise(F.col("total") - F.col("at") + F.col("d")).alias("secs"))


@query("e5_route_length", sql("select route, round(sum(coalesce(sqrt((x_km - px) ** 2 + (y_km - py) ** 2), 0)), 6) as km from (select route, x_km, y_km, lag(x_km) over w as px, lag(y_km) over w as py from stops window w as (partition by route order by seq)) group by route", "stops"))
def e5(spark, sf_dir):
    w = Window.partitionBy("route").orderBy("seq")
    s = Region(spark, sf_dir).stops().withColumn("d", distance(F.col("x_km"), F.col("y_km"), F.lag("x_km").over(w), F.lag("y_km").over(w)))
    return s.groupBy("route").agg(R6(F.sum(F.coalesce("d", F.lit(0.0))), "km"))


@query("e6_schedule_offsets", sql("select route, seq, round(sum(case when px is null then 0 else greatest(1e-6, 1.5 * sqrt((x_km - px) ** 2 + (y_km - py) ** 2) / 30.0) end) over (partition by route order by seq rows unbounded preceding), 6) as offset_h from (select *, lag(x_km) over w as px, lag(y_km) over w as py from stops window w as (partition by route order by seq))", "stops"))
def e6(spark, sf_dir):
    """Schedule times along a line with half as much again for detours; coincident checkpoints are a millionth of an hour apart."""
    w = Window.partitionBy("route").orderBy("seq")
    d = distance(F.col("x_km"), F.col("y_km"), F.lag("x_km").over(w), F.lag("y_km").over(w))
    s = Region(spark, sf_dir).stops().withColumn("h", F.when(d.isNull(), 0.0).otherwise(F.greatest(F.lit(1e-6), 1.5 * d / 30.0)))
    return s.select("route", "seq", R6(F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)), "offset_h"))


@query("e7_arrival_times", sql("select l_orderkey % 50 as vehicle, l_orderkey as trip, l_linenumber as seq, round(sum(0.01 + l_quantity / 600) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding), 6) as arrival_h from lineitem"))
def e7(spark, sf_dir):
    t = Region(spark, sf_dir).table("lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.select((F.col("l_orderkey") % 50).alias("vehicle"), F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq"), R6(F.sum(0.01 + F.col("l_quantity") / 600).over(w), "arrival_h"))


_SECTOR = "select block, ((row_number() over (order by round(atan2(y_km - 2.2, x_km - 2.1), 9), block) - 1) * 6 // 25)::bigint as sector from blocks"


def sectors(r: Region):
    rank = F.row_number().over(Window.orderBy(F.round(F.atan2(F.col("y_km") - 2.2, F.col("x_km") - 2.1), 9), "block")) - 1
    return r.blocks().select("block", F.floor(rank * 6 / 25).alias("sector"))


@query("e8_angular_sectors", sql(_SECTOR, "blocks"))
def e8(spark, sf_dir):
    return sectors(Region(spark, sf_dir))


@query("e9_greedy_packing", sql(f"""with s as (select block, sector, row_number() over (order by sector, block) as i, (1 + block % 4) as q from ({_SECTOR})),
f as (select i, block, q, 1 as vehicle, q as load from s where i = 1 union all select s.i, s.block, s.q, case when f.load + s.q > 10 then f.vehicle + 1 else f.vehicle end, case when f.load + s.q > 10 then s.q else f.load + s.q end from f join s on s.i = f.i + 1)
select block, vehicle::int as vehicle from f""", "blocks", recursive=True))
def e9(spark, sf_dir):
    """Blocks in order of sector, each to the open vehicle or, where it does not fit, to a new one."""
    s = sectors(Region(spark, sf_dir)).select("sector", "block", (1 + F.col("block") % 4).cast("int").alias("q"))
    return packed_in_order(s, "q", 10, "sector", "block").select("block", F.col("vehicle").cast("int").alias("vehicle"))


@query("e9_customer_packing", """with recursive s as (select c_custkey, row_number() over (order by c_nationkey, c_custkey) as i, 1 + c_custkey * 7 % 9 as q from customer),
f as (select i, c_custkey, q, 1 as vehicle, q as load from s where i = 1 union all select s.i, s.c_custkey, s.q, case when f.load + s.q > 40 then f.vehicle + 1 else f.vehicle end, case when f.load + s.q > 40 then s.q else f.load + s.q end from f join s on s.i = f.i + 1)
select c_custkey, vehicle::bigint as vehicle from f""")
def e9_customers(spark, sf_dir):
    """Customers in order of their block, packed into vehicles of 40."""
    c = Region(spark, sf_dir).table("customer").select("c_nationkey", "c_custkey", (1 + F.col("c_custkey") * 7 % 9).cast("long").alias("q"))
    return packed_in_order(c, "q", 40, "c_nationkey", "c_custkey").select("c_custkey", "vehicle")


@query("e10_sector_merges", sql(f"with s as ({_SECTOR}) select a.sector, k::int as width, count(*)::bigint as n_blocks from (select distinct sector from s) a, (select unnest([1, 2, 3]) as k), s b where (b.sector - a.sector + 6) % 6 < k group by all", "blocks"))
def e10(spark, sf_dir):
    """Runs of one to three neighbouring sectors, around the circle."""
    s = sectors(Region(spark, sf_dir)).groupBy("sector").agg(F.count("*").alias("n"))
    runs = s.select("sector", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("width")).select("sector", "width", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("d"))
    return runs.join(s.select(F.col("sector").alias("other"), "n"), (F.col("sector") + F.col("d")) % 6 == F.col("other")).groupBy("sector", "width").agg(F.sum("n").alias("n_blocks"))


@query("e11_gap_test", sql("with r as (select o_orderpriority as g, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders), t as (select g, max(case when rn = 1 then v end) as a, max(case when rn = 2 then v end) as b, max(case when rn = 3 then v end) as c from r where rn <= 3 group by g) select g, (a - b) > 3 * (b - c) as outlier from t"))
def e11(spark, sf_dir):
    """Whether the largest value stands off the next by more than three times the gap after it."""
    w = Window.partitionBy("g").orderBy(F.desc("v"), "o_orderkey")
    o = Region(spark, sf_dir).table("orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v"), "o_orderkey").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("v")))
    return o.groupBy("g").agg(((at(1) - at(2)) > 3 * (at(2) - at(3))).alias("outlier"))


@query("e12_position_rank", sql("select block, row_number() over (order by -y_km, x_km)::int as rank from blocks", "blocks"))
def e12(spark, sf_dir):
    return Region(spark, sf_dir).blocks().select("block", F.row_number().over(Window.orderBy(F.desc("y_km"), "x_km")).alias("rank"))


@query("e13_monotone", sql("select o_orderpriority as g, bool_and(d is null or d <= 1e-9) as falling from (select o_orderpriority, o_totalprice - lag(o_totalprice) over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as d from orders) group by 1"))
def e13(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = Region(spark, sf_dir).table("orders").withColumn("d", F.col("o_totalprice") - F.lag("o_totalprice").over(w))
    return o.groupBy(F.col("o_orderpriority").alias("g")).agg(F.bool_and(F.col("d").isNull() | (F.col("d") <= 1e-9)).alias("falling"))


@query("e14_curvature", sql("""with v as (select route, x_km - lag(x_km) over w as ax, y_km - lag(y_km) over w as ay, lead(x_km) over w - x_km as bx, lead(y_km) over w - y_km as b_y from stops window w as (partition by route order by seq))
select route, round(sum(case when bx is null then 0 else atan2(abs(ax * b_y - ay * bx), ax * bx + ay * b_y) end) / nullif(sum(sqrt(ax * ax + ay * ay)), 0), 6) as curvature from v where ax is not null group by route""", "stops"))
def e14(spark, sf_dir):
    w = Window.partitionBy("route").orderBy("seq")
    x, y = F.col("x_km"), F.col("y_km")
    v = Region(spark, sf_dir).stops().select("route", (x - F.lag(x).over(w)).alias("ax"), (y - F.lag(y).over(w)).alias("ay"), (F.lead(x).over(w) - x).alias("bx"), (F.lead(y).over(w) - y).alias("by")).where("ax is not null")
    a = F.when(F.col("bx").isNull(), 0.0).otherwise(F.atan2(F.abs(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx")), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")))
    length = F.sum(F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")))
    return v.groupBy("route").agg(R6(F.sum(a) / F.nullif(length, F.lit(0.0)), "curvature"))


@query("e15_share", sql("select block, round(p, 6) as p from demand", "demand"))
def e15(spark, sf_dir):
    return Region(spark, sf_dir).demand().select("block", R6("p", "p"))
