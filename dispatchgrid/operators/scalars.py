"""Scalar functions over columns: names, parsing, geometry and cost terms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions import exprs as E
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


def _t(spark, sf_dir, name):
    return Region(spark, sf_dir).table(name)


@query("a6_schedule_hours", sql("select l_suppkey as stop, (try_cast(split_part(t, ':', 1) as int) % 24)::int as hour, count(*)::bigint as n from (select l_suppkey, lpad((l_quantity::int)::varchar, 2, '0') || ':15:00' as t from lineitem) group by all"))
def a6(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stop"), F.concat(F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"), F.lit(":15:00")).alias("t"))
    return t.groupBy("stop", E.gtfs_hour(F.col("t")).alias("hour")).agg(F.count("*").alias("n"))


@query("a9_routes_json", sql("select route, stop, seq, secs from stops", "stops"))
def a9(spark, sf_dir):
    """Stops nested into one JSON text per route and read back by schema."""
    s = Region(spark, sf_dir).stops().groupBy("route").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "stop", "secs")))).alias("j"))
    return s.select("route", F.inline(F.from_json("j", "array<struct<seq:int,stop:bigint,secs:bigint>>"))).select("route", "stop", F.col("seq").cast("bigint").alias("seq"), "secs")


@query("a11_json_map", sql("select event_id, 'k' as key, json_extract(props, '$.k')::bigint as value from events"))
def a11(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>"))).select("event_id", "key", "value")


@query("a13_latest_resource", sql("select event_type as package, arg_max(event_id, (coalesce(case when user_id % 7 = 0 then null else ts end, timestamp '1970-01-01'), event_id)) as resource from events group by 1"))
def a13(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    when = F.coalesce(F.when(F.col("user_id") % 7 != 0, F.col("ts")), F.lit("1970-01-01").cast("timestamp"))
    return e.groupBy(F.col("event_type").alias("package")).agg(F.max_by("event_id", F.struct(when, "event_id")).alias("resource"))


@query("a14_census_rows", sql("select '42' || lpad((c_nationkey)::varchar, 3, '0') || lpad((c_custkey % 1000000)::varchar, 6, '0') || '1' as geoid, coalesce(try_cast(nullif(case when c_custkey % 5 = 0 then 'N/A' else (c_custkey * 3)::varchar end, '') as int), 0)::int as pop from customer"))
def a14(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 5 == 0, F.lit("N/A")).otherwise((F.col("c_custkey") * 3).cast("string"))
    geoid = F.concat(F.lit("42"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"), F.lit("1"))
    return c.select(geoid.alias("geoid"), F.coalesce(raw.try_cast("int"), F.lit(0)).alias("pop"))


@query("a18_json_sink", sql("select o_orderkey, '{\"cents\":' || (round(o_totalprice * 100))::bigint || ',\"status\":\"' || o_orderstatus || '\"}' as j from orders"))
def a18(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderstatus").alias("status"))).alias("j"))


@query("a21_resume", sql("select l::int as setting_index from (select unnest(range(1, 40)) as l) where l not in (select p_size from part where p_partkey % 40 = 0)"))
def a21(spark, sf_dir):
    """Settings whose result is not written yet."""
    done = _t(spark, sf_dir, "part").where("p_partkey % 40 = 0").select(F.col("p_size").alias("setting_index"))
    return spark.range(1, 40).select(F.col("id").cast("int").alias("setting_index")).join(done, "setting_index", "left_anti")


@query("b1_id_suffix", sql("select c_custkey, right(c_name, 7) as block, substr(c_name, -7, 6) as bg, right(c_name, 6) as tract from customer"))
def b1(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.right("c_name", F.lit(7)).alias("block"), F.substring("c_name", -7, 6).alias("bg"), F.right("c_name", F.lit(6)).alias("tract"))


@query("b2_prefix_strip", sql("select c_custkey, case when starts_with(c_name, 'Customer') then right(c_name, 9) else c_name end as geoid from customer"))
def b2(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_name").startswith("Customer"), F.right("c_name", F.lit(9))).otherwise(F.col("c_name")).alias("geoid"))


@query("b3_membership", sql("select c_custkey from customer where c_nationkey in (1, 3, 5, 7, 24)"))
def b3(spark, sf_dir):
    return _t(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(1, 3, 5, 7, 24)).select("c_custkey")


@query("b4_prefix_any", sql("select p_partkey from part where starts_with(p_type, 'ECONOMY') or starts_with(p_type, 'PROMO')"))
def b4(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(F.col("p_type").startswith("ECONOMY") | F.col("p_type").startswith("PROMO")).select("p_partkey")


@query("b5_bounding_box", sql("select stop from stops where x_km between 1 and 3 and y_km between 2 and 4", "stops"))
def b5(spark, sf_dir):
    return Region(spark, sf_dir).stops().where(F.col("x_km").between(1, 3) & F.col("y_km").between(2, 4)).select("stop")


@query("b6_box_overlap", sql("select block from blocks where x_km <= 2.5 and x_km + 1 >= 1.2 and y_km <= 3.5 and y_km + 1 >= 2.2", "blocks"))
def b6(spark, sf_dir):
    return Region(spark, sf_dir).blocks().where("x_km <= 2.5 and x_km + 1 >= 1.2 and y_km <= 3.5 and y_km + 1 >= 2.2").select("block")


@query("b7_valid_rows", sql("select event_id from events where event_type <> 'error' and (value <> 0 or user_id <> 0)"))
def b7(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("event_type <> 'error' and (value <> 0 or user_id <> 0)").select("event_id")


@query("b8_drop_null", sql("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events where try_cast(json_extract_string(props, '$.k') as int) is not null"))
def b8(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")).dropna(subset=["k"])


@query("b9_any_weekday", sql("select l_orderkey, l_linenumber from lineitem where (l_partkey % 2) + (l_suppkey % 3) + (l_linenumber % 2) + (l_quantity::int % 2) + (l_orderkey % 2) > 2"))
def b9(spark, sf_dir):
    flags = F.col("l_partkey") % 2 + F.col("l_suppkey") % 3 + F.col("l_linenumber") % 2 + F.col("l_quantity").cast("int") % 2 + F.col("l_orderkey") % 2
    return _t(spark, sf_dir, "lineitem").where(flags > 2).select("l_orderkey", "l_linenumber")


@query("b10_result_rows", sql("select o_orderkey from orders where o_orderpriority = '2-HIGH' and o_totalprice > 0 and not isnan(o_totalprice) and o_totalprice < 1e5"))
def b10(spark, sf_dir):
    p = F.col("o_totalprice")
    return _t(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "2-HIGH") & (p > 0) & ~F.isnan(p) & (p < 1e5)).select("o_orderkey")


@query("b11_null_fill", sql("select n_nationkey as block, coalesce(n, 0)::bigint as n from nation left join (select s_nationkey, count(*) as n from supplier where s_acctbal > 5000 group by 1) on s_nationkey = n_nationkey"))
def b11(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("block")).agg(F.count("*").alias("n"))
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("block")).join(s, "block", "left").fillna(0)


def strip_units(df):
    """Columns named 'x [unit]' become 'x'."""
    return df.withColumnsRenamed({c: c.split(" [")[0] for c in df.columns if c.endswith("]") and " [" in c})


@query("b12_unit_suffixes", sql("select n_nationkey as block, 1.0::double as area from nation"))
def b12(spark, sf_dir):
    b = Region(spark, sf_dir).blocks().select("block", F.col("area_km2").alias("area"))
    return strip_units(b.withColumnsRenamed({"block": "block [id]", "area": "area [km2]"}))


@query("b15_micro_degrees", sql("select s_suppkey, round((40000000 + s_suppkey * 137) / 1e6, 6) as lat from supplier"))
def b15(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", R6((40000000 + F.col("s_suppkey") * 137) / 1e6, "lat"))


@query("b16_rates", sql("select block, round(100 * p, 4) as percent, round(p * 40, 6) as weighted from demand", "demand"))
def b16(spark, sf_dir):
    return Region(spark, sf_dir).demand().select("block", F.round(100 * F.col("p"), 4).alias("percent"), R6(F.col("p") * 40, "weighted"))


@query("b17_rounded_assignment", sql("select count(*)::bigint as n from (select round_even(l_discount * 10, 0) as z from lineitem) where z = 1"))
def b17(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").where(F.bround(F.col("l_discount") * 10, 0) == 1).agg(F.count("*").alias("n"))


@query("h1_slug", sql("select p_partkey, trim(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '_') as slug from part"))
def h1(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", E.slug(F.col("p_name")).alias("slug"))


@query("h2_number_label", sql("select l_orderkey, l_linenumber, case when l_tax * 50 = floor(l_tax * 50) then floor(l_tax * 50)::bigint::varchar else rtrim(rtrim(printf('%.4f', l_tax * 50), '0'), '.') end as label from lineitem"))
def h2(spark, sf_dir):
    v = F.col("l_tax") * 50
    text = F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", "")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(text).alias("label"))


@query("h3_short_name", sql("select p_partkey, case when contains(p_type, 'ECONOMY') then 'Eco' when contains(p_type, 'PROMO') then 'Promo' else split_part(p_type, ' ', 1) end as short from part"))
def h3(spark, sf_dir):
    t = F.col("p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", F.when(t.contains("ECONOMY"), "Eco").when(t.contains("PROMO"), "Promo").otherwise(F.split_part(t, F.lit(" "), F.lit(1))).alias("short"))


@query("h4_geoid_parts", sql("select c_custkey, substr(g, 1, 2) as state, substr(g, 3, 3) as county, substr(g, 6, 6) as tract, substr(g, 12, 1) as bg from (select c_custkey, lpad((c_custkey * 7919)::varchar, 12, '4') as g from customer)"))
def h4(spark, sf_dir):
    g = F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "4")
    return _t(spark, sf_dir, "customer").select("c_custkey", *(F.substring(g, a, n).alias(k) for k, a, n in (("state", 1, 2), ("county", 3, 3), ("tract", 6, 6), ("bg", 12, 1))))


@query("h5_first_int", sql("select event_id, coalesce(try_cast(split_part(event_type || ';' || user_id, ';', 1) as int), 1)::int as a, coalesce(try_cast(split_part(user_id || ';x', ';', 1) as int), 1)::int as b from events"))
def h5(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", E.first_int(F.concat_ws(";", "event_type", "user_id")).alias("a"), E.first_int(F.concat(F.col("user_id").cast("string"), F.lit(";x"))).alias("b"))


@query("h6_clean_maxspeed", sql("select p_partkey, try_cast(nullif(regexp_replace(p_brand || ' mph', '[^0-9]', '', 'g'), '') as int) as speed from part"))
def h6(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", E.digits_only(F.concat("p_brand", F.lit(" mph"))).alias("speed"))


@query("h7_infer_speed", sql("select p_partkey, (case when contains(p_type, 'PROMO') then 65 when contains(p_type, 'LARGE') then 45 when contains(p_type, 'MEDIUM') then 35 when contains(p_type, 'STANDARD') then 30 else 25 end)::int as mph from part"))
def h7(spark, sf_dir):
    t, out = F.col("p_type"), F.lit(25)
    for word, v in (("STANDARD", 30), ("MEDIUM", 35), ("LARGE", 45), ("PROMO", 65)):
        out = F.when(t.contains(word), F.lit(v)).otherwise(out)
    return _t(spark, sf_dir, "part").select("p_partkey", out.alias("mph"))


@query("h8_presence_flags", sql("select p_partkey, (case when nullif(p_size % 3, 0) is not null then 1 else 0 end)::int as is_bridge from part"))
def h8(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") % 3, F.lit(0)).isNotNull().cast("int").alias("is_bridge"))


@query("h9_linear_odd", sql("select p_partkey, round(coalesce(0.5 * p_size, 0) + coalesce(0.01 * (p_retailprice - 200), 0) + (case p_size % 4 when 0 then 5 when 1 then 12 else 25 end), 6) as cost from part"))
def h9(spark, sf_dir):
    pen = F.coalesce(F.element_at(F.create_map(F.lit(0), F.lit(5), F.lit(1), F.lit(12)), F.col("p_size") % 4), F.lit(25))
    return _t(spark, sf_dir, "part").select("p_partkey", R6(F.coalesce(0.5 * F.col("p_size"), F.lit(0.0)) + F.coalesce(0.01 * (F.col("p_retailprice") - 200), F.lit(0.0)) + pen, "cost"))


@query("h11_schedule_hour", sql("select l_orderkey, l_linenumber, (coalesce(try_cast(split_part(l_quantity::int || ':30:00', ':', 1) as int), 0) % 24)::int as hour from lineitem"))
def h11(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.gtfs_hour(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":30:00"))).alias("hour"))


@query("h12_date_plus_time", sql("select o_orderkey, hour(t)::int as hour, dayname(t) as weekday from (select o_orderkey, o_orderdate + to_minutes((o_custkey % 1440)::bigint) as t from orders)"))
def h12(spark, sf_dir):
    t = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_custkey") % 1440).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.hour(t).alias("hour"), F.date_format(t, "EEEE").alias("weekday"))


@query("h15_cache_key", sql("select stop, sha1(printf('%.5f', x_km) || ':' || printf('%.5f', y_km)) as key from stops", "stops"))
def h15(spark, sf_dir):
    return Region(spark, sf_dir).stops().select("stop", F.sha1(F.concat_ws(":", F.format_string("%.5f", "x_km"), F.format_string("%.5f", "y_km"))).alias("key"))


@query("h16_haversine", sql(f"select stop, round(2 * {E.EARTH_KM} * asin(sqrt(least(1.0, sin(radians(y_km / 10) / 2) ** 2 + cos(radians(40)) * cos(radians(40 + y_km / 10)) * sin(radians(x_km / 10) / 2) ** 2))), 6) as km from stops", "stops"))
def h16(spark, sf_dir):
    return Region(spark, sf_dir).stops().select("stop", R6(E.haversine_km(F.lit(40.0), F.lit(-80.0), 40 + F.col("y_km") / 10, -80 + F.col("x_km") / 10), "km"))


@query("h17_euclidean", sql("select stop, round(sqrt((x_km - 1) ** 2 + (y_km - 2) ** 2), 6) as km from stops", "stops"))
def h17(spark, sf_dir):
    return Region(spark, sf_dir).stops().select("stop", R6(E.distance(F.col("x_km"), F.col("y_km"), F.lit(1.0), F.lit(2.0)), "km"))


@query("h18_point_segment", sql("select stop, round(sqrt((x_km - 1 - 3 * t) ** 2 + (y_km - 1 - 2 * t) ** 2), 6) as km from (select *, greatest(0.0, least(1.0, ((x_km - 1) * 3 + (y_km - 1) * 2) / 13.0)) as t from stops)", "stops"))
def h18(spark, sf_dir):
    return Region(spark, sf_dir).stops().select("stop", R6(E.segment_distance(F.col("x_km"), F.col("y_km"), F.lit(1.0), F.lit(1.0), F.lit(4.0), F.lit(3.0)), "km"))


_LAEA = f"select stop, sqrt(2 / (1 + {math.sin(math.radians(45))} * sin(p) + {math.cos(math.radians(45))} * cos(p) * cos(d))) as k, p, d from (select stop, radians(40 + y_km / 10) as p, radians(-80 + x_km / 10) - {math.radians(-100)} as d from stops)"


@query("h20_equal_area", sql(f"select stop, round(6370997.0 * k * cos(p) * sin(d), 3) as x, round(6370997.0 * k * ({math.cos(math.radians(45))} * sin(p) - {math.sin(math.radians(45))} * cos(p) * cos(d)), 3) as y from ({_LAEA})", "stops"))
def h20(spark, sf_dir):
    x, y = E.equal_area_xy(40 + F.col("y_km") / 10, -80 + F.col("x_km") / 10)
    return Region(spark, sf_dir).stops().select("stop", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("h22_polygon_area", sql("select block, 1.0::double as area, x_km + 0.5 as cx, y_km + 0.5 as cy from blocks", "blocks"))
def h22(spark, sf_dir):
    """Shoelace area and centroid of each block's ring."""
    ring = F.array(*(F.struct((F.col("x_km") + dx).alias("x"), (F.col("y_km") + dy).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))))
    b = Region(spark, sf_dir).blocks().select("block", ring.alias("r"))
    n = F.size("r")
    at = lambda i: F.get("r", i % n)
    cross = lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"]
    total = lambda f: F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), f), F.lit(0.0), lambda s, v: s + v)
    b = b.withColumn("area", total(cross) / 2)
    cx = total(lambda i: (at(i)["x"] + at(i + 1)["x"]) * cross(i)) / (6 * F.col("area"))
    cy = total(lambda i: (at(i)["y"] + at(i + 1)["y"]) * cross(i)) / (6 * F.col("area"))
    return b.select("block", R6("area", "area"), R6(cx, "cx"), R6(cy, "cy"))


@query("h23_radius", sql("select round(avg(2 * sqrt(area_km2 / pi())), 6) as diameter from blocks", "blocks"))
def h23(spark, sf_dir):
    return Region(spark, sf_dir).blocks().agg(R6(F.avg(2 * F.sqrt(F.col("area_km2") / math.pi)), "diameter"))


@query("h24_walk_geometry", sql("select block, round(case when 0.05 * block >= sqrt(1 / pi()) then 0 else 2 * sqrt(1 / pi()) / 3 - 0.05 * block + (0.05 * block) ** 3 / (3 / pi()) end, 6) as walk from blocks", "blocks"))
def h24(spark, sf_dir):
    r = F.sqrt(F.col("area_km2") / math.pi)
    return Region(spark, sf_dir).blocks().select("block", R6(E.mean_walk_km(r, 0.05 * F.col("block")), "walk"))


@query("h27_fleet", sql("select o_orderkey, round(case when km <= 0 then 0 else km / 15.0 end, 6) as amortised, (case when km <= 0 then 0 else ceil(greatest(km / 15.0 - 1e-12, 0)) end)::double as whole from (select o_orderkey, (o_custkey % 40)::double as km from orders)"))
def h27(spark, sf_dir):
    a, w = E.fleet_sizes((F.col("o_custkey") % 40).cast("double"), F.lit(0.5))
    return _t(spark, sf_dir, "orders").select("o_orderkey", R6(a, "amortised"), w.alias("whole"))


@query("h28_tour_length", sql(f"select block, round({E.TOUR_CONSTANT} * sqrt(150 * 0.5) * p, 6) as km from demand", "demand"))
def h28(spark, sf_dir):
    return Region(spark, sf_dir).demand().select("block", R6(E.tour_km(F.col("p"), F.lit(150.0), F.lit(0.5)), "km"))


@query("h30_fleet_bounds", sql("select block, greatest(1, ceil(150 * p / 8))::bigint as lower, greatest(1, ceil(150 * p / 8 + 2 * sqrt(150 * p)))::bigint as upper from demand", "demand"))
def h30(spark, sf_dir):
    mean = 150 * F.col("p")
    bound = lambda x: F.greatest(F.lit(1).cast("bigint"), F.ceil(x))
    return Region(spark, sf_dir).demand().select("block", bound(mean / 8).alias("lower"), bound(mean / 8 + 2 * F.sqrt(mean)).alias("upper"))


@query("h31_log_clip", sql("select o_orderkey, round(log10(o_totalprice), 6) as lg, least(9, greatest(0, floor(o_totalprice / 50000)))::int as bin from orders where o_totalprice > 0"))
def h31(spark, sf_dir):
    b = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("o_totalprice") / 50000))).cast("int")
    return _t(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_orderkey", R6(F.log10("o_totalprice"), "lg"), b.alias("bin"))


@query("h32_angles", sql("select stop, round(case when a < 0 then a + 2 * pi() else a end, 6) as angle from (select stop, atan2(y_km - 2.51, x_km - 2.52) as a from stops)", "stops"))
def h32(spark, sf_dir):
    a = F.atan2(F.col("y_km") - 2.51, F.col("x_km") - 2.52)
    return Region(spark, sf_dir).stops().select("stop", R6(F.when(a < 0, a + 2 * math.pi).otherwise(a), "angle"))


@query("h33_spaces", sql("select i::int as i, round(lo + i * (hi - lo) / 8.0, 6) as lin, round(lo * pow(hi / lo, i / 8.0), 6) as log from (select unnest(range(9)) as i), (select min(p_size)::double as lo, max(p_size)::double as hi from part)"))
def h33(spark, sf_dir):
    """Nine values from the least size of a part to the largest, in even steps and in even ratios."""
    r = Region(spark, sf_dir).table("part").agg(F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    r = r.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(i.alias("i"), (lo + i * (hi - lo) / 8.0).alias("lin"), (lo * F.pow(hi / lo, i / 8.0)).alias("log")))).alias("s"))
    return r.select("s.i", R6("s.lin", "lin"), R6("s.log", "log"))


@query("h35_time_budget", sql("select stop, round(greatest(1e-6, 1.5 * sqrt((x_km - 2.5) ** 2 + (y_km - 2.5) ** 2) / 30), 6) as hours from stops", "stops"))
def h35(spark, sf_dir):
    return Region(spark, sf_dir).stops().select("stop", R6(F.greatest(F.lit(1e-6), 1.5 * E.distance(F.col("x_km"), F.col("y_km"), F.lit(2.5), F.lit(2.5)) / 30), "hours"))


@query("h37_route_name", sql("select route, coalesce(case when route = 1 then 'Downtown' end, 'Route ' || route) as name from (select distinct route from stops)", "stops"))
def h37(spark, sf_dir):
    name = F.coalesce(F.when(F.col("route") == 1, F.lit("Downtown")), F.concat(F.lit("Route "), F.col("route").cast("string")))
    return Region(spark, sf_dir).stops().select("route").distinct().select("route", name.alias("name"))


@query("h38_one_hot_argmax", sql("select vec_id, list_position(embedding, list_max(embedding))::bigint as label from embeddings"))
def h38(spark, sf_dir):
    v = F.col("embedding")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.array_position(v, F.array_max(v)).alias("label"))
