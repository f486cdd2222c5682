"""Small operators: grids, generators, names, extracts of a partition and look-ups with fall-backs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions import exprs as E
from dispatchgrid.operators.evaluate import ARRIVALS, TERMS_SQL, WR, _terms, newton_sql
from dispatchgrid.operators.scenarios import poisson_quantile
from dispatchgrid.plans.region import ODD_WEIGHTS, Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)
U = E.uniform_sql


def legs(r: Region) -> DataFrame:
    """route, seq, ax, ay, bx, by: the ways between stops that follow one another."""
    s = r.stops()
    nxt = s.select("route", (F.col("seq") - 1).alias("seq"), F.col("x_km").alias("bx"), F.col("y_km").alias("by"))
    return s.select("route", "seq", F.col("x_km").alias("ax"), F.col("y_km").alias("ay")).join(nxt, ["route", "seq"])


def crosses_box(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, half: float) -> Column:
    """Whether a segment meets the square of side 2 * half about (cx, cy): the stretch of it inside both pairs of sides."""

    def stretch(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
        lo, hi = (c - half - a) / (b - a), (c + half - a) / (b - a)
        level = F.when(F.abs(a - c) <= half, F.lit(0.0)).otherwise(F.lit(2.0))  # no way along this axis: inside for all of it, or never
        return F.when(a == b, level).otherwise(F.least(lo, hi)), F.when(a == b, F.lit(1.0)).otherwise(F.greatest(lo, hi))

    (x0, x1), (y0, y1) = stretch(ax, bx, cx), stretch(ay, by, cy)
    return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))


@query("c8_line_in_polygon", sql("""with l as (select a.route, a.seq, a.x_km as ax, a.y_km as ay, b.x_km as bx, b.y_km as b_y from stops a join stops b on a.route = b.route and b.seq = a.seq + 1),
t as (select route, seq, block, case when ax = bx then case when abs(ax - x_km) <= 0.5 then 0.0 else 2.0 end else least((x_km - 0.5 - ax) / (bx - ax), (x_km + 0.5 - ax) / (bx - ax)) end as x0, case when ax = bx then 1.0 else greatest((x_km - 0.5 - ax) / (bx - ax), (x_km + 0.5 - ax) / (bx - ax)) end as x1,
case when ay = b_y then case when abs(ay - y_km) <= 0.5 then 0.0 else 2.0 end else least((y_km - 0.5 - ay) / (b_y - ay), (y_km + 0.5 - ay) / (b_y - ay)) end as y0, case when ay = b_y then 1.0 else greatest((y_km - 0.5 - ay) / (b_y - ay), (y_km + 0.5 - ay) / (b_y - ay)) end as y1 from l, blocks)
select route, seq, block from t where greatest(x0, y0, 0.0) <= least(x1, y1, 1.0)""", "stops", "blocks"))
def c8(spark, sf_dir):
    """Every block square that a route's segment runs through: segments are dealt to the cells of their boxes, then tested."""
    r = Region(spark, sf_dir)
    span = lambda a, b: F.sequence(F.ceil(F.least(a, b) - 0.5), F.floor(F.greatest(a, b) + 0.5))
    s = legs(r).withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    b = r.blocks().select("block", F.col("x_km").cast("bigint").alias("cx"), F.col("y_km").cast("bigint").alias("cy"))
    return s.join(b, ["cx", "cy"]).where(crosses_box(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")), 0.5)).select("route", "seq", "block")


def settings(spark, **values: list) -> DataFrame:
    """Every combination of the values of some parameters; as many rows as the product of their numbers."""
    out = spark.range(1).select()
    for name, v in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, v))).alias(name))
    return out


@query("c23_settings_grid", "select mode, l::double as arrivals_h, w::double as wr from (select distinct o_orderpriority as mode from orders), (select distinct p_size * 10 as l from part where p_size <= 20), (select distinct l_linenumber as w from lineitem)")
def c23(spark, sf_dir):
    r = Region(spark, sf_dir)
    values = lambda t, c: sorted(x[0] for x in r.table(t).select(c).distinct().collect())  # noqa: E731  kinds, a few of each
    return settings(spark, mode=values("orders", F.col("o_orderpriority")), arrivals_h=[v * 10.0 for v in values("part", F.col("p_size")) if v <= 20], wr=[float(v) for v in values("lineitem", F.col("l_linenumber"))])


def mesh(spark, lo: float, hi: float, res: int) -> DataFrame:
    """ix, iy, x, y of evenly spaced points, both ends included."""
    step = (hi - lo) / (res - 1)
    i, j = F.floor(F.col("id") / res), F.col("id") % res
    return spark.range(res * res).select(i.alias("ix"), j.alias("iy"), (lo + i * step).alias("x"), (lo + j * step).alias("y"))


@query("c24_grid_mesh", "select ix, iy, round(lo + ix * ((hi - lo) / (n - 1)), 6) as x, round(lo + iy * ((hi - lo) / (n - 1)), 6) as y from (select min(s_acctbal) as lo, max(s_acctbal) as hi, (select 4 * count(*) from nation) as n from supplier), lateral (select unnest(range(n)) as ix), lateral (select unnest(range(n)) as iy)")
def c24(spark, sf_dir):
    """A mesh over the range of balances, with four lines a block."""
    r = Region(spark, sf_dir)
    b = r.table("supplier").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi")).first()
    return mesh(spark, b["lo"], b["hi"], 4 * r.blocks().count()).select("ix", "iy", R6("x", "x"), R6("y", "y"))


def stamped(prefix: str, at: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(suffix))


@query("h14_stamped_names", "select event_type, 'results_' || strftime(max(ts), '%Y%m%d_%H%M%S') || '.csv' as name from events group by event_type")
def h14(spark, sf_dir):
    """Names of outputs by the time of what they hold."""
    e = Region(spark, sf_dir).table("events").groupBy("event_type").agg(F.max("ts").alias("at"))
    return e.select("event_type", stamped("results", F.col("at"), ".csv").alias("name"))


@query("h21_polyline", sql("select route, seq, round(40 + y_km / 10, 5) as lat, round(-80 + x_km / 10, 5) as lon from stops", "stops"))
def h21(spark, sf_dir):
    """The stops of each route from encoded polylines of fifty stops each."""
    from dispatchgrid.sources.files import decode_polyline, encode_polyline

    stop = F.struct("seq", (40 + F.col("y_km") / 10).alias("lat"), (-80 + F.col("x_km") / 10).alias("lon"))
    lines = Region(spark, sf_dir).stops().groupBy("route", F.floor((F.col("seq") - 1) / 50).alias("part")).agg(F.array_sort(F.collect_list(stop)).alias("p"))
    lines = lines.select("route", "part", encode_polyline(F.col("p")).alias("line"))
    vertices = lines.select("route", "part", F.posexplode(decode_polyline(F.col("line"))).alias("i", "v"))
    return vertices.select("route", (F.col("part") * 50 + F.col("i") + 1).alias("seq"), F.round("v.lat", 5).alias("lat"), F.round("v.lon", 5).alias("lon"))


@query("h36_difficulty_generators", sql(f"""with g as (select block, {U("block", "g1")} as g1, {U("block", "g2")} as g2, [{", ".join(U("block", f"b{i}") for i in range(6))}] as b, x_km, y_km from blocks)
select block, round(-ln(greatest(g1, 1e-12)) - ln(greatest(g2, 1e-12)), 6) as gamma, round(list_sort(b)[2], 6) as beta, round(5 * exp(-((x_km - 2) ** 2 + (y_km - 2) ** 2) / 4), 6) as spatial, round(0.6 * list_sort(b)[2] + 0.4 * sqrt(list_sort(b)[2]), 6) as cost from g""", "blocks"))
def h36(spark, sf_dir):
    """Difficulty drawn as Gamma(2, 1), Beta(2, 5) (the second of six uniforms) and by place, and a curved cost of it."""
    u = lambda salt: E.hash_uniform(F.col("block"), salt)
    log = lambda salt: F.log(F.greatest(u(salt), F.lit(1e-12)))
    beta = F.get(F.array_sort(F.array(*(u(f"b{i}") for i in range(6)))), F.lit(1))
    x, y = F.col("x_km") - 2, F.col("y_km") - 2
    return Region(spark, sf_dir).blocks().select("block", R6(-log("g1") - log("g2"), "gamma"), R6(beta, "beta"), R6(5 * F.exp(-(x * x + y * y) / 4), "spatial"), R6(0.6 * beta + 0.4 * F.sqrt(beta), "cost"))


#: Unit of each feature column, appended to its name on export.
UNITS = {"p_size": "m", "p_retailprice": "usd"}


@query("b13_unit_names", "select p_partkey, p_size as \"p_size [m]\", p_retailprice as \"p_retailprice [usd]\" from part")
def b13(spark, sf_dir):
    return Region(spark, sf_dir).table("part").select("p_partkey", *UNITS).withColumnsRenamed({c: f"{c} [{u}]" for c, u in UNITS.items()})


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all the columns; ValueError names those that are missing."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


@query("b14_required_columns", "select count(*)::bigint as n from orders")
def b14(spark, sf_dir):
    return require(Region(spark, sf_dir).table("orders"), "o_orderkey", "o_custkey", "o_totalprice").agg(F.count("*").alias("n"))


PAD = 30
_DRAWN = f"select i, 5 * {U('i', 'rx')} - 0.5 as x, 5 * {U('i', 'ry')} - 0.5 as y from (select unnest(range(600)) as i)"


@query("i16_rejection_sampling", sql(f"""with d as ({_DRAWN}), k as (select district, i, x, y, row_number() over (partition by district order by i) as n from d join blocks on x_km = floor(x + 0.5) and y_km = floor(y + 0.5)),
c as (select district, avg(x_km) as x, avg(y_km) as y from blocks group by district), pad as (select c.district, n.n, c.x, c.y from c, (select unnest(range(1, {PAD + 1})) as n) n where n.n > (select count(*) from k where k.district = c.district))
select district, n::int as n, round(x, 6) as x, round(y, 6) as y from k where n <= {PAD} union all select district, n::int, round(x, 6), round(y, 6) from pad""", "blocks"))
def i16(spark, sf_dir):
    """Thirty points a district: those of the region's draws that fall into its blocks, the first ones, and its centre for the rest."""
    r = Region(spark, sf_dir)
    u = lambda salt: 5 * E.hash_uniform(F.col("id"), salt) - 0.5
    d = spark.range(600).select("id", u("rx").alias("x"), u("ry").alias("y"))
    cells = r.blocks().select("district", F.col("x_km").cast("bigint").alias("cx"), F.col("y_km").cast("bigint").alias("cy"))
    inside = d.withColumn("cx", F.floor(F.col("x") + 0.5)).withColumn("cy", F.floor(F.col("y") + 0.5)).join(F.broadcast(cells), ["cx", "cy"])
    kept = inside.withColumn("n", F.row_number().over(Window.partitionBy("district").orderBy("id"))).where(F.col("n") <= PAD).select("district", "n", "x", "y")
    centre = r.blocks().groupBy("district").agg(F.avg("x_km").alias("px"), F.avg("y_km").alias("py"))
    places = centre.select("*", F.explode(F.sequence(F.lit(1), F.lit(PAD))).alias("n"))
    return places.join(kept, ["district", "n"], "left").select("district", "n", R6(F.coalesce("x", "px"), "x"), R6(F.coalesce("y", "py"), "y"))


@query("k5_path_tree", sql("select b.block, coalesce((select min(e.src) from edges e where e.dst = b.block and (e.src % 5) + (e.src // 5) < (b.block % 5) + (b.block // 5)), -1)::int as previous, ((b.block % 5) + (b.block // 5))::double as km from blocks b", "blocks", "edges"))
def k5(spark, sf_dir):
    """The way from the first block to each: its length and the block before it, the smallest where several are, -1 for none."""
    from dispatchgrid.operators.graphs import shortest_paths

    r = Region(spark, sf_dir)
    to = shortest_paths(r.edges(), r.blocks().where("block = 0")).select(F.col("dst").alias("block"), "km")
    back = r.edges().select("src", F.col("dst").alias("block"), F.col("km").alias("step")).join(to.select(F.col("block").alias("src"), F.col("km").alias("upto")), "src")
    last = back.join(to, "block").where(F.abs(F.col("upto") + F.col("step") - F.col("km")) < 1e-9).groupBy("block").agg(F.min("src").alias("previous"))
    return to.join(last, "block", "left").select("block", F.coalesce("previous", F.lit(-1)).alias("previous"), "km")


@query("l23_assignment_models", sql("with d as (select src as block, dst as centre, km from dist where dst in (6, 8, 16, 18)) select block, arg_min(centre, (round(km, 9), centre)) as centre, round(min(km), 6) as whole, round(min(km), 6) as shares from d group by block", "dist"))
def l23(spark, sf_dir):
    """Each block to a centre, in whole and in shares: without side constraints the least cost in shares is at a whole one."""
    d = Region(spark, sf_dir).distances().where(F.col("dst").isin(6, 8, 16, 18))
    g = d.groupBy(F.col("src").alias("block")).agg(F.min_by("dst", F.struct(F.round("km", 9), "dst")).alias("centre"), F.min("km").alias("km"))
    return g.select("block", "centre", R6("km", "whole"), R6("km", "shares"))


@query("l20_elementwise_max", sql("select district, round(max(omega1), 6) as omega1, round(max(omega2), 6) as omega2 from blocks join odd using (block) group by district", "blocks", "odd"))
def l20(spark, sf_dir):
    r = Region(spark, sf_dir)
    return r.blocks().join(r.odd(), "block").groupBy("district").agg(R6(F.max("omega1"), "omega1"), R6(F.max("omega2"), "omega2"))


@query("m6_line_access", sql("""with l as (select route, seq, x_km, y_km, lead(x_km) over w as nx, lead(y_km) over w as ny, row_number() over (partition by route order by seq desc) as back from stops window w as (partition by route order by seq))
select route, round(sum(case when seq = 1 then sqrt((x_km - 2) ** 2 + (y_km - 2) ** 2) else 0 end + case when back = 1 then sqrt((x_km - 2) ** 2 + (y_km - 2) ** 2) else 0 end), 6) as access_km, round(sum(coalesce(sqrt((nx - x_km) ** 2 + (ny - y_km) ** 2), 0)), 6) as line_km from l group by route""", "stops"))
def m6(spark, sf_dir):
    """From the depot to a line's first checkpoint and home from its last, and the way along it."""
    r = Region(spark, sf_dir)
    out = E.distance(F.col("x"), F.col("y"), F.lit(2.0), F.lit(2.0))
    ends = r.stops().groupBy("route").agg(F.min_by(F.struct(F.col("x_km").alias("x"), F.col("y_km").alias("y")), "seq").alias("a"), F.max_by(F.struct(F.col("x_km").alias("x"), F.col("y_km").alias("y")), "seq").alias("b"))
    access = ends.select("route", F.explode(F.array("a", "b")).alias("e")).select("route", "e.*").groupBy("route").agg(F.sum(out).alias("access"))
    line = legs(r).groupBy("route").agg(F.sum(E.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("line"))
    return access.join(line, "route", "left").select("route", R6("access", "access_km"), R6(F.coalesce("line", F.lit(0.0)), "line_km"))


@query("p7_appearance_ratio", sql("with g as (select o_orderpriority as factor, avg(o_totalprice) as mean, count(*) as n from orders group by 1) select factor, n::bigint as n, round(mean / (select mean from g order by factor limit 1), 6) as ratio from g"))
def p7(spark, sf_dir):
    """Mean by factor, and its ratio to the first factor's."""
    g = Region(spark, sf_dir).table("orders").groupBy(F.col("o_orderpriority").alias("factor")).agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))
    first = g.agg(F.min_by("mean", "factor").alias("first"))
    return g.crossJoin(F.broadcast(first)).select("factor", "n", R6(F.col("mean") / F.col("first"), "ratio"))


@query("s1_assignment_matrix", sql("select block, " + ", ".join(f"(district = {k})::int as d{k}" for k in range(5)) + " from blocks", "blocks"))
def s1(spark, sf_dir):
    """The assignment as one column of zeros and ones a district, for export."""
    p = Region(spark, sf_dir).blocks().groupBy("block").pivot("district", list(range(5))).agg(F.count(F.lit(1)))
    return p.select("block", *(F.coalesce(F.col(str(k)), F.lit(0)).cast("int").alias(f"d{k}") for k in range(5)))


_T = newton_sql("(linehaul_km + odd_cost)", "alpha", str(ARRIVALS), str(WR))


@query("s2_subproblem", sql(TERMS_SQL + f" select district, round(odd_cost, 6) as odd_cost, round({_T}, 6) as T from terms", "blocks", "demand", "odd", "dist", "depot"))
def s2(spark, sf_dir):
    """A district's difficulty cost from its features, then its best interval."""
    r = Region(spark, sf_dir)
    cost = sum((w * F.coalesce(F.max(f"omega{i + 1}"), F.lit(0.0)) for i, w in enumerate(ODD_WEIGHTS[1:], 1)), ODD_WEIGHTS[0] * F.coalesce(F.max("omega1"), F.lit(0.0)))
    odd = r.blocks().join(r.odd(), "block", "left").groupBy("district").agg(cost.alias("own"))
    t = _terms(spark, sf_dir).join(odd, "district")
    return t.select("district", R6("own", "odd_cost"), R6(E.dispatch_interval(F.col("linehaul_km") + F.col("own"), F.col("alpha"), F.lit(ARRIVALS), F.lit(WR)), "T"))


@query("s3_position_fallback", sql("select block, case when block % 3 = 0 then (block % 5) * 1000.0::double else 1000 * x_km + 1 end as x_m from blocks", "blocks"))
def s3(spark, sf_dir):
    known = F.when(F.col("block") % 3 != 0, 1000 * F.col("x_km") + 1)
    return Region(spark, sf_dir).blocks().select("block", F.coalesce(known, (F.col("block") % 5) * 1000.0).alias("x_m"))


@query("s5_district_extract", sql("select district, count(*)::bigint as n, string_agg(block, ',' order by block) as members, round(sum(coalesce(p, 0)), 6) as mass from blocks left join demand using (block) group by district", "blocks", "demand"))
def s5(spark, sf_dir):
    r = Region(spark, sf_dir)
    d = r.blocks().join(r.demand(), "block", "left").groupBy("district")
    return d.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("block")), lambda b: b.cast("string")), ",").alias("members"), R6(F.sum(F.coalesce("p", F.lit(0.0))), "mass"))


@query("s7_defaults", sql("select block, coalesce(k, 0.0)::double as k, coalesce(f, 0.0)::double as f from blocks left join (select s_nationkey as block, max(s_acctbal)::double as k, min(s_acctbal)::double as f from supplier group by s_nationkey) using (block)", "blocks"))
def s7(spark, sf_dir):
    r = Region(spark, sf_dir)
    known = r.table("supplier").groupBy(F.col("s_nationkey").alias("block")).agg(F.max("s_acctbal").cast("double").alias("k"), F.min("s_acctbal").cast("double").alias("f"))
    return r.blocks().select("block").join(known, "block", "left").fillna(0.0)


@query("s13_members", sql("select block from blocks where district = 2", "blocks"))
def s13(spark, sf_dir):
    return Region(spark, sf_dir).blocks().where("district = 2").select("block")


_MIX = ((1.0, 1.0, 0.40, 0.9), (3.0, 1.0, 0.35, 1.0), (2.0, 3.0, 0.25, 0.75))
_PDF = " + ".join(f"{w} * exp(-((x - {cx}) ** 2 + (y - {cy}) ** 2) / (2 * {s} * {s})) / (2 * pi() * {s} * {s})" for cx, cy, w, s in _MIX)


def mixture_pdf(x: Column, y: Column) -> Column:
    terms = [w * F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * s * s)) / (2 * math.pi * s * s) for cx, cy, w, s in _MIX]
    return sum(terms[1:], terms[0])


@query("s18_mixture_on_grid", f"select ix, iy, round({_PDF}, 9) as pdf from (select ix, iy, ix * (w / 49) as x, iy * (w / 49) as y from (select unnest(range(50)) as ix), (select unnest(range(50)) as iy), (select max(n_nationkey % 5)::double as w from nation))")
def s18(spark, sf_dir):
    width = Region(spark, sf_dir).blocks().agg(F.max("x_km")).first()[0]
    return mesh(spark, 0.0, width, 50).select("ix", "iy", F.round(mixture_pdf(F.col("x"), F.col("y")), 9).alias("pdf"))


_K, _A, _B = U("i", "mk"), f"greatest({U('i', 'ma')}, 1e-12)", U("i", "mb")


@query("s17_nominal_histogram", sql(f"""with u as (select i, {_K} as k, sqrt(-2 * ln({_A})) as r, 2 * pi() * {_B} as a from (select unnest(range(3000)) as i)),
p as (select case when k < 0.40 then 1.0 + 0.9 * r * cos(a) when k < 0.75 then 3.0 + r * cos(a) else 2.0 + 0.75 * r * cos(a) end as x, case when k < 0.40 then 1.0 + 0.9 * r * sin(a) when k < 0.75 then 1.0 + r * sin(a) else 3.0 + 0.75 * r * sin(a) end as y from u)
select block, count(*)::bigint as n from p join blocks on x_km = floor(x + 0.5) and y_km = floor(y + 0.5) group by block""", "blocks"))
def s17(spark, sf_dir):
    """Draws of a mixture counted by block; those outside the region go."""
    u = lambda salt: E.hash_uniform(F.col("id"), salt)
    rad, ang = F.sqrt(-2 * F.log(F.greatest(u("ma"), F.lit(1e-12)))), 2 * math.pi * u("mb")
    k = u("mk")
    pick = lambda f: F.when(k < 0.40, f(_MIX[0])).when(k < 0.75, f(_MIX[1])).otherwise(f(_MIX[2]))
    p = spark.range(3000).select(pick(lambda m: m[0] + m[3] * rad * F.cos(ang)).alias("x"), pick(lambda m: m[1] + m[3] * rad * F.sin(ang)).alias("y"))
    cells = Region(spark, sf_dir).blocks().select("block", F.col("x_km").cast("bigint").alias("cx"), F.col("y_km").cast("bigint").alias("cy"))
    return p.withColumn("cx", F.floor(F.col("x") + 0.5)).withColumn("cy", F.floor(F.col("y") + 0.5)).join(F.broadcast(cells), ["cx", "cy"]).groupBy("block").agg(F.count("*").alias("n"))


@query("s20_random_demand", sql(f"""with c as (select k, sum(exp(-50.0 + k * ln(50.0) - lgamma(k + 1.0))) over (order by k) as cdf from (select unnest(range(140)) as k)), u as (select block, {U("block", "rd")} as u from blocks),
q as (select block, greatest(10, count(*) filter (where u > cdf)) as q from u, c group by block) select block, q::bigint as q, round(q::double / sum(q) over (), 6) as share from q""", "blocks"))
def s20(spark, sf_dir):
    """Ten or a Poisson draw of mean 50, whichever is more, and its share."""
    q = Region(spark, sf_dir).blocks().select("block", F.greatest(F.lit(10), poisson_quantile(F.lit(50.0), E.hash_uniform(F.col("block"), "rd"))).cast("bigint").alias("q"))
    return q.select("block", "q", R6(F.col("q") / F.sum("q").over(Window.partitionBy()), "share"))


def setting_named(configs: DataFrame, name: str) -> DataFrame:
    """The one configuration of a name; ValueError where there is none."""
    found = configs.where(F.col("name") == name)
    if not found.limit(1).count():
        raise ValueError(f"no configuration is named {name}")
    return found


@query("s21_named_setting", "select r_name as name, count(*)::int as blocks, (r_regionkey + 2)::int as districts from region join nation on n_regionkey = r_regionkey where r_name = 'ASIA' group by r_name, r_regionkey")
def s21(spark, sf_dir):
    r = Region(spark, sf_dir)
    rows = r.table("region").join(r.table("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name"), (F.col("r_regionkey") + 2).cast("int").alias("districts")).agg(F.count("*").cast("int").alias("blocks"))
    return setting_named(rows.select("name", "blocks", "districts"), "ASIA")


@query("s22_metadata_fallback", sql("""select block, coalesce(a, r, c, -1)::int as root from blocks left join (select block, district as a from blocks where block % 4 = 0) using (block) left join (select block, district + 10 as r from blocks where block % 3 = 0) using (block) left join (select block, district + 20 as c from blocks where block % 2 = 0) using (block)""", "blocks"))
def s22(spark, sf_dir):
    """The root a block is assigned to, else one that reaches it, else that of a checkpoint, else none."""
    b = Region(spark, sf_dir).blocks()
    known = lambda step, plus, name: b.where(F.col("block") % step == 0).select("block", (F.col("district") + plus).alias(name))
    out = b.select("block").join(known(4, 0, "a"), "block", "left").join(known(3, 10, "r"), "block", "left").join(known(2, 20, "c"), "block", "left")
    return out.select("block", F.coalesce("a", "r", "c", F.lit(-1)).cast("int").alias("root"))


@query("s23_walk_geometry", sql("select block, round(sqrt(area_km2 / pi()), 6) as radius, round(case when 0.2 >= sqrt(area_km2 / pi()) then 0 else 2 * sqrt(area_km2 / pi()) / 3 - 0.2 + 0.008 / (3 * area_km2 / pi()) end, 6) as walk_km from blocks", "blocks"))
def s23(spark, sf_dir):
    radius = F.sqrt(F.col("area_km2") / math.pi)
    return Region(spark, sf_dir).blocks().select("block", R6(radius, "radius"), R6(E.mean_walk_km(radius, F.lit(0.2)), "walk_km"))


@query("s28_centermost", sql("select block from (select block, row_number() over (order by round(sqrt((x_km - (select avg(x_km) from blocks)) ** 2 + (y_km - (select avg(y_km) from blocks)) ** 2), 9), block) as n from blocks) where n <= 9", "blocks"))
def s28(spark, sf_dir):
    """The nine blocks nearest to the middle, for a map."""
    w = Window.partitionBy()
    d = E.distance(F.col("x_km"), F.col("y_km"), F.avg("x_km").over(w), F.avg("y_km").over(w))
    return Region(spark, sf_dir).blocks().select("block", F.round(d, 9).alias("d")).orderBy("d", "block").limit(9).select("block")


@query("a15_zonal_mean", sql("with g as (select ix, iy, (ix + 0.5) / 8 - 0.5 as x, (iy + 0.5) / 8 - 0.5 as y, 100 + 3.0::double * ix + 0.5 * iy + (ix * iy) % 7 as elev from (select unnest(range(40)) as ix), (select unnest(range(40)) as iy)) select block, round(avg(elev), 6) as elevation from g join blocks on x_km = floor(x + 0.5) and y_km = floor(y + 0.5) group by block", "blocks"))
def a15(spark, sf_dir):
    """Mean elevation of the raster cells whose middles lie in each block."""
    i, j = F.floor(F.col("id") / 40), F.col("id") % 40
    g = spark.range(1600).select(((i + 0.5) / 8 - 0.5).alias("x"), ((j + 0.5) / 8 - 0.5).alias("y"), (100 + 3.0 * i + 0.5 * j + (i * j) % 7).alias("elev"))
    cells = Region(spark, sf_dir).blocks().select("block", F.col("x_km").cast("bigint").alias("cx"), F.col("y_km").cast("bigint").alias("cy"))
    return g.withColumn("cx", F.floor(F.col("x") + 0.5)).withColumn("cy", F.floor(F.col("y") + 0.5)).join(F.broadcast(cells), ["cx", "cy"]).groupBy("block").agg(R6(F.avg("elev"), "elevation"))


@query("a16_road_graph", sql("select a.stop as u, b.stop as v, round(1000 * sqrt((a.x_km - b.x_km) ** 2 + (a.y_km - b.y_km) ** 2), 3) as length_m from stops a join stops b on a.route = b.route and b.seq = a.seq + 1 where a.x_km between 1 and 4 and a.y_km between 1 and 4 and b.x_km between 1 and 4 and b.y_km between 1 and 4", "stops"))
def a16(spark, sf_dir):
    """Edges both of whose ends lie in a bounding box, with their lengths."""
    s = Region(spark, sf_dir).stops().where("x_km between 1 and 4 and y_km between 1 and 4")
    b = s.select(F.col("stop").alias("v"), "route", (F.col("seq") - 1).alias("seq"), F.col("x_km").alias("bx"), F.col("y_km").alias("by"))
    return s.join(b, ["route", "seq"]).select(F.col("stop").alias("u"), "v", F.round(1000 * E.distance(F.col("x_km"), F.col("y_km"), F.col("bx"), F.col("by")), 3).alias("length_m"))


@query("a20_result_lines", "select rpad(o_orderpriority, 16, ' ') || ' | ' || lpad(count(*)::varchar, 8, ' ') || ' | ' || lpad((round(sum(o_totalprice)))::bigint::varchar, 14, ' ') as line from orders group by o_orderpriority")
def a20(spark, sf_dir):
    """A results table as text lines of fixed width."""
    g = Region(spark, sf_dir).table("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).cast("bigint").alias("total"))
    return g.select(F.concat(F.rpad("o_orderpriority", 16, " "), F.lit(" | "), F.lpad(F.col("n").cast("string"), 8, " "), F.lit(" | "), F.lpad(F.col("total").cast("string"), 14, " ")).alias("line"))
