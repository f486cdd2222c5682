"""Equi, range, nearest and spatial joins of the feature pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.exprs import distance
from dispatchgrid.operators.nearest import nearest
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


@query("c1_block_tract_totals", sql("select c_custkey, round(c_acctbal / t.total, 6) as share from customer join (select c_nationkey, sum(c_acctbal) as total from customer group by 1) t using (c_nationkey)"))
def c1(spark, sf_dir):
    """Each block's share of its tract; the totals are one small row per tract."""
    c = Region(spark, sf_dir).table("customer")
    t = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("total"))
    return c.join(t, "c_nationkey").select("c_custkey", R6(F.col("c_acctbal") / F.col("total"), "share"))


@query("c2_block_commuting", sql("select c_custkey, coalesce(n, 0)::bigint as transit from customer left join (select s_nationkey, count(*) as n from supplier group by 1) on s_nationkey = c_nationkey"))
def c2(spark, sf_dir):
    r = Region(spark, sf_dir)
    s = r.table("supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"))
    return r.table("customer").join(s, "c_nationkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("transit"))


@query("c3_tract_block_group", sql("select r_regionkey as tract, r_name as name_tract, n_nationkey as bg, n_name as name_bg from region left join nation on n_regionkey = r_regionkey"))
def c3(spark, sf_dir):
    r = Region(spark, sf_dir)
    n = r.table("nation").select(F.col("n_regionkey").alias("tract"), F.col("n_nationkey").alias("bg"), F.col("n_name").alias("name_bg"))
    return r.table("region").select(F.col("r_regionkey").alias("tract"), F.col("r_name").alias("name_tract")).join(n, "tract", "left")


@query("c4_feature_assembly", sql("""select block, coalesce(customers, 0)::bigint as customers, coalesce(suppliers, 0)::bigint as suppliers, coalesce(parts, 0)::bigint as parts, round(coalesce(p, 0), 6) as p, coalesce(n_events, 0)::bigint as n_events from blocks
left join (select c_nationkey as block, count(*) as customers from customer group by 1) using (block) left join (select s_nationkey as block, count(*) as suppliers from supplier group by 1) using (block)
left join (select p_partkey % 25 as block, count(*) as parts from part group by 1) using (block) left join demand using (block) left join (select user_id % 25 as block, count(*) as n_events from events group by 1) using (block)""", "blocks", "demand"))
def c4(spark, sf_dir):
    r = Region(spark, sf_dir)
    per = lambda t, key, name: r.table(t).groupBy(key.cast("int").alias("block")).agg(F.count("*").alias(name))
    out = r.blocks().select("block")
    for f in (per("customer", F.col("c_nationkey"), "customers"), per("supplier", F.col("s_nationkey"), "suppliers"), per("part", F.col("p_partkey") % 25, "parts"), r.demand(), per("events", F.col("user_id") % 25, "n_events")):
        out = out.join(f, "block", "left")
    return out.fillna(0).select("block", "customers", "suppliers", "parts", R6("p", "p"), "n_events")


@query("c5_aggregate_elevation", sql("select a.block, round(a.speed, 6) as speed, round(100 + 3.0 * a.block, 6) as elevation from (select p_partkey % 25 as block, avg(p_retailprice) as speed from part group by 1) a join blocks b on a.block = b.block", "blocks"))
def c5(spark, sf_dir):
    r = Region(spark, sf_dir)
    a = r.table("part").groupBy((F.col("p_partkey") % 25).alias("block")).agg(F.avg("p_retailprice").alias("speed"))
    e = r.blocks().select("block", (100 + 3.0 * F.col("block")).alias("elevation"))
    return a.join(F.broadcast(e), a.block == e.block).select(a.block, R6("speed", "speed"), R6("elevation", "elevation"))


@query("c6_hourly_counts_filled", sql("select block, h::int as hour, coalesce(n, 0)::bigint as n from blocks cross join (select unnest(range(24)) as h) left join (select user_id % 25 as b, hour(ts) as hh, count(*) as n from events group by all) on b = block and hh = h", "blocks"))
def c6(spark, sf_dir):
    r = Region(spark, sf_dir)
    c = r.table("events").groupBy((F.col("user_id") % 25).cast("int").alias("block"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    every = r.blocks().select("block", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return every.join(c, ["block", "hour"], "left").fillna(0)


@query("c7_point_in_polygon", sql("select stop, block from stops join blocks b on stops.x_km >= b.x_km and stops.x_km < b.x_km + 1 and stops.y_km >= b.y_km and stops.y_km < b.y_km + 1", "stops", "blocks"))
def c7(spark, sf_dir):
    """Points in unit-square polygons: an equi-join on the grid cell, then ray casting over the ring."""
    r = Region(spark, sf_dir)
    ring = F.array(*(F.struct((F.col("x_km") + dx).alias("x"), (F.col("y_km") + dy).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))))
    polygons = r.blocks().select("block", F.floor("x_km").alias("cx"), F.floor("y_km").alias("cy"), ring.alias("ring"))
    points = r.stops().select("stop", "x_km", "y_km", F.floor("x_km").alias("cx"), F.floor("y_km").alias("cy"))
    return points.join(polygons, ["cx", "cy"]).where(inside(F.col("x_km"), F.col("y_km"), F.col("ring"))).select("stop", "block")


def inside(x, y, ring):
    """Whether (x, y) lies in a polygon, lower and left sides included: an odd number of crossings to the right."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        up = (a["y"] <= y) != (b["y"] <= y)
        return F.when(up & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


_SEGMENTS = "select route, seq, x_km as ax, y_km as ay, lead(x_km) over (partition by route order by seq) as bx, lead(y_km) over (partition by route order by seq) as b_y from stops"


@query("c9_segment_touches_block", sql(f"select block, exists (select 1 from ({_SEGMENTS}) s where bx is not null and least(ax, bx) <= x_km + 1 and greatest(ax, bx) >= x_km and least(ay, b_y) <= y_km + 1 and greatest(ay, b_y) >= y_km) as near_line from blocks", "stops", "blocks"))
def c9(spark, sf_dir):
    """Blocks whose box meets the box of a segment of a route: segments dealt to the cells they span."""
    r = Region(spark, sf_dir)
    w = Window.partitionBy("route").orderBy("seq")
    s = r.stops().select("seq", "x_km", "y_km", F.lead("x_km").over(w).alias("bx"), F.lead("y_km").over(w).alias("by")).where("bx is not null")
    span = lambda a, b: F.sequence(F.ceil(F.least(a, b)) - 1, F.floor(F.greatest(a, b)))
    cells = s.select(F.explode(span("x_km", "bx")).alias("cx"), "y_km", "by").select("cx", F.explode(span("y_km", "by")).alias("cy")).distinct().withColumn("hit", F.lit(True))
    b = r.blocks().select("block", F.col("x_km").cast("bigint").alias("cx"), F.col("y_km").cast("bigint").alias("cy"))
    return b.join(cells, ["cx", "cy"], "left").select("block", F.coalesce("hit", F.lit(False)).alias("near_line"))


@query("c11_nearest_stop", sql("select block, arg_min(stop, (round(sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2), 9), route, seq)) as stop, round(min(sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2)), 6) as km from blocks b, stops s group by block", "blocks", "stops"))
def c11(spark, sf_dir):
    """Nearest stop over all routes; ties to the first route, then the first stop on it."""
    r = Region(spark, sf_dir)
    s = r.stops().withColumn("rank", F.struct("route", "seq", "stop"))
    return nearest(r.blocks(), s, "block", "rank").select("block", F.col("pick.stop").alias("stop"), R6("km", "km"))


@query("c12_nearest_on_own_route", sql("select block, route, round(min(sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2)), 6) as km from blocks b join stops s on b.block % 3 = s.route group by all", "blocks", "stops"))
def c12(spark, sf_dir):
    r = Region(spark, sf_dir)
    b = r.blocks().select("block", (F.col("block") % 3).alias("route"), F.col("x_km").alias("x"), F.col("y_km").alias("y"))
    return b.join(r.stops(), "route").groupBy("block", "route").agg(R6(F.min(distance(F.col("x"), F.col("y"), F.col("x_km"), F.col("y_km"))), "km"))


@query("c13_nearest_block_of_cell", sql("select cell, arg_min(block, (round((cx - x_km) ** 2 + (cy - y_km) ** 2, 9), block)) as block from (select i * 40 + j as cell, (i + 0.5) / 8 as cx, (j + 0.5) / 8 as cy from (select unnest(range(40)) as i), (select unnest(range(40)) as j)), blocks group by cell", "blocks"))
def c13(spark, sf_dir):
    r = Region(spark, sf_dir)
    cells = grid(spark, 40, 5.0)
    return nearest(cells, r.blocks(), "cell", "block").select("cell", F.col("pick").alias("block"))


def grid(spark, n: int, size: float):
    """Cell middles of an n by n grid over a square."""
    i = F.floor(F.col("id") / n)
    return spark.range(n * n).select(F.col("id").alias("cell"), ((i + 0.5) * (size / n)).alias("x_km"), ((F.col("id") % n + 0.5) * (size / n)).alias("y_km"))


@query("c14_nearest_cell_of_block", sql("select block, arg_min(cell, (round((cx - x_km) ** 2 + (cy - y_km) ** 2, 9), cell)) as cell from (select i * 40 + j as cell, (i + 0.5) / 8 as cx, (j + 0.5) / 8 as cy from (select unnest(range(40)) as i), (select unnest(range(40)) as j)), blocks group by block", "blocks"))
def c14(spark, sf_dir):
    return nearest(Region(spark, sf_dir).blocks(), grid(spark, 40, 5.0), "block", "cell").select("block", F.col("pick").alias("cell"))


_CENTERS = "select distinct arg_min(block, (round(sqrt((x_km - mx) ** 2 + (y_km - my) ** 2), 9), block)) over (partition by district) as center from (select *, avg(x_km) over (partition by district) as mx, avg(y_km) over (partition by district) as my from blocks)"


@query("c20_nearest_center", sql(f"with centers as ({_CENTERS}) select src as block, arg_min(center, (round(km, 9), center)) as center, round(min(km), 6) as km from dist join centers on dst = center group by src", "blocks", "dist"))
def c20(spark, sf_dir):
    """Each block to the nearest of the fixed centres, which is what an assignment model without side constraints gives."""
    from dispatchgrid.operators.sets import f3

    r = Region(spark, sf_dir)
    d = r.distances().join(F.broadcast(f3(spark, sf_dir).select(F.col("root").alias("dst"))), "dst")
    return d.groupBy(F.col("src").alias("block")).agg(F.min_by("dst", F.struct(F.round("km", 9), "dst")).alias("center"), R6(F.min("km"), "km"))


@query("c21_corridor", sql(f"""with g as ({_SEGMENTS}), s as (select * from g where bx is not null), d as (select block, route, seq, (bx - ax) ** 2 + (b_y - ay) ** 2 as l, ((x_km - ax) * (bx - ax) + (y_km - ay) * (b_y - ay)) as t, ax, ay, bx, b_y, x_km, y_km from blocks, s)
select block, route, seq from (select *, case when l <= 0 then 0 else greatest(0.0, least(1.0, t / nullif(l, 0))) end as f from d) where sqrt((x_km - ax - f * (bx - ax)) ** 2 + (y_km - ay - f * (b_y - ay)) ** 2) <= 0.4""", "stops", "blocks"))
def c21(spark, sf_dir):
    """Blocks within 0.4 km of a route segment: segments are dealt to the unit cells their widened box spans, then tested."""
    from dispatchgrid.functions.exprs import segment_distance

    r = Region(spark, sf_dir)
    w = Window.partitionBy("route").orderBy("seq")
    s = r.stops().select("route", "seq", F.col("x_km").alias("ax"), F.col("y_km").alias("ay"), F.lead("x_km").over(w).alias("bx"), F.lead("y_km").over(w).alias("by")).where("bx is not null")
    reach = 0.4
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) - reach), F.floor(F.greatest(a, b) + reach))
    s = s.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    b = r.blocks().select("block", "x_km", "y_km", F.floor("x_km").alias("cx"), F.floor("y_km").alias("cy"))
    near = segment_distance(F.col("x_km"), F.col("y_km"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= reach
    return s.join(b, ["cx", "cy"]).where(near).select("block", "route", "seq")


@query("c22_distance_matrix", sql("select src, dst, round(km, 6) as km from dist", "blocks", "dist"))
def c22(spark, sf_dir):
    return Region(spark, sf_dir).distances().select("src", "dst", R6("km", "km"))


@query("c25_queen_contiguity", sql("select a.block as src, b.block as dst from blocks a, blocks b where a.block <> b.block and abs(a.x_km - b.x_km) <= 1 and abs(a.y_km - b.y_km) <= 1", "blocks"))
def c25(spark, sf_dir):
    """Polygons that share a vertex: an equi-join on the vertices of their rings."""
    corners = F.explode(F.array(*(F.struct((F.col("x_km") + dx).alias("x"), (F.col("y_km") + dy).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)))))
    v = Region(spark, sf_dir).blocks().select("block", corners.alias("v")).select("block", F.round("v.x", 6).alias("x"), F.round("v.y", 6).alias("y"))
    return v.select(F.col("block").alias("src"), "x", "y").join(v.select(F.col("block").alias("dst"), "x", "y"), ["x", "y"]).where("src <> dst").select("src", "dst").distinct()


@query("c26_rook_adjacency", sql("select src, dst from edges", "edges"))
def c26(spark, sf_dir):
    return Region(spark, sf_dir).edges().select("src", "dst")


@query("c27_refinement", sql("select block * 4 + i * 2 + j as fine, block as parent, round(x_km + (i - 0.5) / 2, 6) as x_km, round(y_km + (j - 0.5) / 2, 6) as y_km, round(coalesce(p, 0) / 4, 6) as p from blocks left join demand using (block), (select unnest(range(2))::int as i), (select unnest(range(2))::int as j)", "blocks", "demand"))
def c27(spark, sf_dir):
    """Each block into four, its demand shared evenly."""
    r = Region(spark, sf_dir)
    b = r.blocks().join(r.demand(), "block", "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    i, j = F.floor(F.col("k") / 2), F.col("k") % 2
    return b.select((F.col("block") * 4 + F.col("k")).cast("bigint").alias("fine"), F.col("block").alias("parent"), R6(F.col("x_km") + (i - 0.5) / 2, "x_km"), R6(F.col("y_km") + (j - 0.5) / 2, "y_km"), R6(F.coalesce("p", F.lit(0.0)) / 4, "p"))


@query("c28_ratio_to_reference", sql("with m as (select o_orderstatus as n, o_orderpriority as f, avg(o_totalprice) as v from orders group by all) select m.n, m.f, round(m.v / r.v, 6) as ratio from m join m r on r.n = m.n and r.f = '1-URGENT'"))
def c28(spark, sf_dir):
    """Each factor's mean against the reference factor's with the same n."""
    m = Region(spark, sf_dir).table("orders").groupBy(F.col("o_orderstatus").alias("n"), F.col("o_orderpriority").alias("f")).agg(F.avg("o_totalprice").alias("v"))
    ref = F.max(F.when(F.col("f") == "1-URGENT", F.col("v"))).over(Window.partitionBy("n"))
    return m.select("n", "f", R6(F.col("v") / ref, "ratio"))


@query("c29_lookup_with_default", sql("select p_partkey, coalesce(case p_size % 10 when 1 then 5 when 2 then 9 when 3 then 14 end, 25)::int as penalty from part"))
def c29(spark, sf_dir):
    table = F.create_map(*(F.lit(x) for kv in {1: 5, 2: 9, 3: 14}.items() for x in kv))
    return Region(spark, sf_dir).table("part").select("p_partkey", F.coalesce(F.element_at(table, F.col("p_size") % 10), F.lit(25)).alias("penalty"))
