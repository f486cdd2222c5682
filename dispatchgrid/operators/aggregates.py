"""Grouped aggregations of the feature pipelines and result summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.medians import exact_medians
from dispatchgrid.functions.ordered import Ordered
from dispatchgrid.plans.region import Region, minmax, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


@query("d1_sum_by_tract", sql("select n_regionkey as tract, round(sum(c_acctbal), 2) as total, count(*)::bigint as n from customer join nation on c_nationkey = n_nationkey group by n_regionkey"))
def d1(spark, sf_dir):
    r = Region(spark, sf_dir)
    per = r.table("customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    return per.join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("tract")).agg(F.round(F.sum("s"), 2).alias("total"), F.sum("n").alias("n"))


@query("d2_activity_by_block", sql("select (floor(x_km)::int + 5 * floor(y_km)::int) as block, sum(secs)::bigint as activity, count(*)::bigint as n_stops from stops group by 1", "stops"))
def d2(spark, sf_dir):
    block = (F.floor("x_km") + 5 * F.floor("y_km")).cast("int")
    return Region(spark, sf_dir).stops().groupBy(block.alias("block")).agg(F.sum("secs").alias("activity"), F.count("*").alias("n_stops"))


_TRIPS = "select l_suppkey as stop, (l_partkey + l_linenumber) % 24 as hour, l_orderkey as trip from lineitem where l_returnflag <> 'R'"


@query("d3_mean_of_hourly_counts", sql(f"select stop, round(avg(n), 6) as trips_per_hour from (select stop, hour, count(*) as n from ({_TRIPS}) group by stop, hour) group by stop"))
def d3(spark, sf_dir):
    """Trips per stop and hour, then the mean over the hours that have any."""
    t = Region(spark, sf_dir).table("lineitem").where("l_returnflag <> 'R'")
    per = t.groupBy(F.col("l_suppkey").alias("stop"), ((F.col("l_partkey") + F.col("l_linenumber")) % 24).alias("hour")).count()
    return per.groupBy("stop").agg(R6(F.avg("count"), "trips_per_hour"))


@query("d4_daily_mean", sql("select round(avg(n), 6) as mean_daily, max(n)::bigint as most from (select ts::date as day, count(*) as n from events where event_type <> 'error' group by 1)"))
def d4(spark, sf_dir):
    d = Region(spark, sf_dir).table("events").where("event_type <> 'error'").groupBy(F.to_date("ts").alias("day")).count()
    return d.agg(R6(F.avg("count"), "mean_daily"), F.max("count").alias("most"))


@query("d5_count_block_hour_weekday", sql("select user_id % 25 as block, hour(ts)::int as hour, dayname(ts) as weekday, count(*)::bigint as n from events group by all"))
def d5(spark, sf_dir):
    e = Region(spark, sf_dir).table("events")
    return e.groupBy((F.col("user_id") % 25).alias("block"), F.hour("ts").alias("hour"), F.date_format("ts", "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


@query("d6_value_counts", sql("select event_type as value, count(*)::bigint as n, round(count(*) / sum(count(*)) over (), 6) as share from events group by event_type"))
def d6(spark, sf_dir):
    c = Region(spark, sf_dir).table("events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_ROADS = """select p_partkey % 25 as block, p_size % 6 + 1 as lanes, p_brand as surface, p_retailprice as speed,
 case when p_type like '%SMALL%' then 'residential' when p_type like '%STANDARD%' then 'tertiary' when p_type like '%MEDIUM%' then 'secondary' when p_type like '%LARGE%' then 'primary' when p_type like '%ECONOMY%' then 'unclassified' else 'trunk' end as class from part"""
_RANK = {"trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "unclassified": 5, "residential": 6}


def roads(spark, sf_dir):
    t = F.col("p_type")
    kind = F.lit("trunk")
    for word, name in (("ECONOMY", "unclassified"), ("LARGE", "primary"), ("MEDIUM", "secondary"), ("STANDARD", "tertiary"), ("SMALL", "residential")):
        kind = F.when(t.contains(word), F.lit(name)).otherwise(kind)
    p = Region(spark, sf_dir).table("part")
    return p.select((F.col("p_partkey") % 25).alias("block"), (F.col("p_size") % 6 + 1).alias("lanes"), F.col("p_brand").alias("surface"), F.col("p_retailprice").alias("speed"), kind.alias("class"))


@query("d7_road_features", sql(f"""with roads as ({_ROADS}), m as (select block, surface, count(*) as n from roads group by all)
select block, round(avg(speed), 6) as mean_speed, max(lanes)::int as max_lanes, min(lanes)::int as min_lanes, (select min(surface) from m where m.block = roads.block and n = (select max(n) from m m2 where m2.block = roads.block)) as surface from roads group by block"""))
def d7(spark, sf_dir):
    """Mean, extremes and mode (the smallest of the commonest) of road attributes by block."""
    r = roads(spark, sf_dir)
    modes = r.groupBy("block", "surface").count().groupBy("block").agg(F.min_by("surface", F.struct(-F.col("count"), "surface")).alias("surface"))
    return r.groupBy("block").agg(R6(F.avg("speed"), "mean_speed"), F.max("lanes").cast("int").alias("max_lanes"), F.min("lanes").cast("int").alias("min_lanes")).join(modes, "block")


@query("d8_hardest_road", sql(f"with roads as ({_ROADS}) select block, arg_max(class, (case class " + " ".join(f"when '{k}' then {v}" for k, v in _RANK.items()) + " else 7 end, class)) as class from roads group by block"))
def d8(spark, sf_dir):
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _RANK.items() for x in kv)), F.col("class")), F.lit(7))
    return roads(spark, sf_dir).groupBy("block").agg(F.max_by("class", F.struct(rank, "class")).alias("class"))


@query("d9_mean_std", sql("select o_orderpriority as design, o_orderstatus as setting, round(avg(o_totalprice), 1) as mean_cost, round(stddev_samp(o_totalprice), 1) as std_cost, count(*)::bigint as n from orders group by all"))
def d9(spark, sf_dir):
    o = Region(spark, sf_dir).table("orders")
    return o.groupBy(F.col("o_orderpriority").alias("design"), F.col("o_orderstatus").alias("setting")).agg(F.round(F.avg("o_totalprice"), 1).alias("mean_cost"), F.round(F.stddev_samp("o_totalprice"), 1).alias("std_cost"), F.count("*").alias("n"))


@query("d10_mean_std_pivot", sql("""select o_orderpriority as design, """ + ", ".join(f"max(case when o_orderstatus = '{s}' then t end) as {s}" for s in "FOP") + """ from (select o_orderpriority, o_orderstatus, printf('%.1f ± %.1f', avg(o_totalprice), stddev_samp(o_totalprice)) as t from orders group by all) group by o_orderpriority"""))
def d10(spark, sf_dir):
    text = F.format_string("%.1f ± %.1f", F.avg("o_totalprice"), F.stddev_samp("o_totalprice"))
    return Region(spark, sf_dir).table("orders").groupBy(F.col("o_orderpriority").alias("design")).pivot("o_orderstatus", ["F", "O", "P"]).agg(text)


@query("d11_by_factor", sql("select n_regionkey as factor, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as std, min(c_acctbal) as lo, max(c_acctbal) as hi from customer join nation on n_nationkey = c_nationkey group by 1"))
def d11(spark, sf_dir):
    r = Region(spark, sf_dir)
    c = r.table("customer").join(F.broadcast(r.table("nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.groupBy(F.col("n_regionkey").alias("factor")).agg(R6(F.avg("c_acctbal"), "mean"), R6(F.stddev_samp("c_acctbal"), "std"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


@query("d12_pivot", sql("select l_returnflag as y, " + ", ".join(f"round(avg(case when l_linestatus = '{s}' then l_discount end), 6) as {s}" for s in "FO") + " from lineitem group by 1"))
def d12(spark, sf_dir):
    return Region(spark, sf_dir).table("lineitem").groupBy(F.col("l_returnflag").alias("y")).pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_discount"), 6))


@query("d13_group_sizes", sql("select o_orderpriority as baseline, count(*)::bigint as n from orders group by 1"))
def d13(spark, sf_dir):
    return Region(spark, sf_dir).table("orders").groupBy(F.col("o_orderpriority").alias("baseline")).agg(F.count("*").alias("n"))


@query("d18_district_sums", sql("select district, sum(area_km2) as area_km2, round(sum(coalesce(p, 0)), 6) as mass, count(*)::bigint as n_blocks from blocks left join demand using (block) group by district", "blocks", "demand"))
def d18(spark, sf_dir):
    r = Region(spark, sf_dir)
    return r.blocks().join(r.demand(), "block", "left").groupBy("district").agg(F.sum("area_km2").alias("area_km2"), R6(F.sum(F.coalesce("p", F.lit(0.0))), "mass"), F.count("*").alias("n_blocks"))


@query("d20_weighted_rollup", sql("select round(sum(p * omega1) / sum(p), 6) as mean_omega, round(max(omega1), 6) as worst from demand join odd using (block)", "demand", "blocks", "odd"))
def d20(spark, sf_dir):
    r = Region(spark, sf_dir)
    return r.demand().join(r.odd(), "block").agg(R6(F.sum(F.col("p") * F.col("omega1")) / F.sum("p"), "mean_omega"), R6(F.max("omega1"), "worst"))


@query("d22_modal_profile", sql("select arg_min(k, (-n, k)) as k, max(n)::bigint as n from (select l_linenumber as k, count(*) as n from lineitem where l_linenumber > 0 group by 1)"))
def d22(spark, sf_dir):
    c = Region(spark, sf_dir).table("lineitem").where("l_linenumber > 0").groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"))
    return c.agg(F.min_by("k", F.struct(-F.col("n"), "k")).alias("k"), F.max("n").alias("n"))


@query("d24_median_mad", sql("with m as (select median(o_totalprice) as m from orders) select round(m, 6) as median, round((select median(abs(o_totalprice - m)) from orders), 6) as mad from m"))
def d24(spark, sf_dir):
    o = Region(spark, sf_dir).table("orders").select("o_totalprice")
    m = exact_medians(o, F.col("o_totalprice")).select(F.col("median").alias("m"))
    d = exact_medians(o.crossJoin(F.broadcast(m)), F.abs(F.col("o_totalprice") - F.col("m"))).select(F.col("median").alias("mad"))
    return m.crossJoin(d).select(R6("m", "median"), R6("mad", "mad"))


@query("d25_median_speed", sql("select round(coalesce(median(km / (secs / 3600.0)), 20.0), 6) as speed from (select sqrt((x_km - lag(x_km) over w) ** 2 + (y_km - lag(y_km) over w) ** 2) as km, secs from stops window w as (partition by route order by seq)) where km is not null", "stops"))
def d25(spark, sf_dir):
    from dispatchgrid.functions.exprs import distance

    w = Window.partitionBy("route").orderBy("seq")
    s = Region(spark, sf_dir).stops()
    s = s.select(distance(F.col("x_km"), F.col("y_km"), F.lag("x_km").over(w), F.lag("y_km").over(w)).alias("km"), "secs").where("km is not null")
    m = exact_medians(s, F.col("km") / (F.col("secs") / 3600.0)).agg(F.max("median").alias("m"))
    return m.select(R6(F.coalesce("m", F.lit(20.0)), "speed"))


@query("d26_occupancy_histogram", sql("select least(4, floor(x_km))::int + 5 * least(4, floor(y_km))::int as block, round(count(*) / (select count(*) from stops), 6) as p from stops group by 1", "stops"))
def d26(spark, sf_dir):
    s = Region(spark, sf_dir).stops()
    block = F.least(F.lit(4), F.floor("x_km")).cast("int") + 5 * F.least(F.lit(4), F.floor("y_km")).cast("int")
    c = s.groupBy(block.alias("block")).count()
    return c.select("block", R6(F.col("count") / F.sum("count").over(Window.partitionBy()), "p"))


@query("d27_weighted_bincount", sql("select bin, round(w, 6) as w, round(sum(w) over (order by bin), 6) as running from (select floor(o_totalprice / 50000)::int as bin, sum(o_totalprice / 1e6) as w from orders group by 1)"))
def d27(spark, sf_dir):
    b = Region(spark, sf_dir).table("orders").groupBy(F.floor(F.col("o_totalprice") / 50000).cast("int").alias("bin")).agg(F.sum(F.col("o_totalprice") / 1e6).alias("w"))
    return Ordered(b, "bin").running(running=F.col("w")).select("bin", R6("w", "w"), R6("running", "running"))


@query("d28_best_stop_cluster", sql("select n_routes, n_stops, round(x, 6) as x, round(y, 6) as y from (select count(distinct route)::bigint as n_routes, count(*)::bigint as n_stops, avg(x_km) as x, avg(y_km) as y, round(x_km) as cx, round(y_km) as cy from stops group by cx, cy order by 1 desc, 2 desc, cx, cy limit 1)", "stops"))
def d28(spark, sf_dir):
    """The cell with most routes, then most stops; the limit is the operator."""
    s = Region(spark, sf_dir).stops().groupBy(F.round("x_km").alias("cx"), F.round("y_km").alias("cy"))
    c = s.agg(F.countDistinct("route").alias("n_routes"), F.count("*").alias("n_stops"), F.avg("x_km").alias("x"), F.avg("y_km").alias("y"))
    return c.orderBy(F.desc("n_routes"), F.desc("n_stops"), "cx", "cy").limit(1).select("n_routes", "n_stops", R6("x", "x"), R6("y", "y"))


@query("d29_entropy", sql("select round(greatest(0.0, least(1.0, -sum((p + 1e-12) * ln(p + 1e-12)) / ln(count(*)))), 6) as uniformity from demand", "demand"))
def d29(spark, sf_dir):
    p = F.col("p") + 1e-12
    u = -F.sum(p * F.log(p)) / F.log(F.count("*"))
    return Region(spark, sf_dir).demand().agg(R6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)), "uniformity"))


@query("d31_cycle_time", sql("select route, sum(secs)::bigint as cycle_secs, round(sum(secs) / 3600.0, 6) as cycle_h, count(*)::bigint as n_stops from stops group by route", "stops"))
def d31(spark, sf_dir):
    return Region(spark, sf_dir).stops().groupBy("route").agg(F.sum("secs").alias("cycle_secs"), R6(F.sum("secs") / 3600.0, "cycle_h"), F.count("*").alias("n_stops"))


@query("d32_minmax", sql("select block, round(coalesce((customers - min(customers) over ()) / nullif(max(customers) over () - min(customers) over (), 0), 0), 6) as scaled from odd_counts", "blocks", "odd_counts"))
def d32(spark, sf_dir):
    r = Region(spark, sf_dir)
    c = r.table("customer").groupBy(F.col("c_nationkey").alias("block")).agg(F.count("*").alias("customers"))
    return r.blocks().select("block").join(c, "block", "left").fillna(0).select("block", R6(minmax("customers"), "scaled"))


@query("d33_argmin_selection", sql("select o_orderpriority as baseline, arg_min(o_orderkey, (o_totalprice + 0.5 * o_custkey, o_orderkey)) as pick, round(min(o_totalprice + 0.5 * o_custkey), 6) as cost from orders group by 1"))
def d33(spark, sf_dir):
    cost = F.col("o_totalprice") + 0.5 * F.col("o_custkey")
    return Region(spark, sf_dir).table("orders").groupBy(F.col("o_orderpriority").alias("baseline")).agg(F.min_by("o_orderkey", F.struct(cost, "o_orderkey")).alias("pick"), R6(F.min(cost), "cost"))


@query("d34_any_fallback", sql("select block, round(case when (select max(suppliers) from odd_counts) > 0 then suppliers else customers end, 6) as activity from odd_counts", "blocks", "odd_counts"))
def d34(spark, sf_dir):
    r = Region(spark, sf_dir)
    c = r.table("customer").groupBy(F.col("c_nationkey").alias("block")).agg(F.count("*").alias("customers"))
    s = r.table("supplier").groupBy(F.col("s_nationkey").alias("block")).agg(F.count("*").alias("suppliers"))
    b = r.blocks().select("block").join(c, "block", "left").join(s, "block", "left").fillna(0)
    some = F.max("suppliers").over(Window.partitionBy()) > 0
    return b.select("block", R6(F.when(some, F.col("suppliers")).otherwise(F.col("customers")).cast("double"), "activity"))


@query("d35_nansum_vector", sql("select vec_id, round(list_sum(list_filter(embedding::double[], lambda x: not isnan(x))), 6) as total from embeddings"))
def d35(spark, sf_dir):
    v = F.filter("embedding", lambda x: ~F.isnan(x))
    return Region(spark, sf_dir).table("embeddings").select("vec_id", R6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), "total"))
