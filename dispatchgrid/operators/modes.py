"""Service modes as compositions of the other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions import exprs as E
from dispatchgrid.operators.evaluate import ARRIVALS, TERMS_SQL, WR, _terms, evaluate_design, evaluation_sql, newton_sql
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


@query("o10_spatial_only", evaluation_sql("0.25::double"))
def o10(spark, sf_dir):
    """Districts under one fixed interval."""
    return evaluate_design(_terms(spark, sf_dir), F.lit(0.25))


@query("o16_cost_breakdown", sql(TERMS_SQL + f""", t as (select *, {newton_sql("(linehaul_km + odd_cost)", "alpha", str(ARRIVALS), str(WR))} as T from terms)
select district, round(linehaul_km / T, 6) as linehaul_per_h, round(odd_cost / T, 6) as odd_per_h, round({E.TOUR_CONSTANT} * sqrt({ARRIVALS} * T) * alpha / T, 6) as travel_per_h, round({ARRIVALS} * {WR} * mass * T / 2, 6) as waiting_per_h from t""", "blocks", "demand", "odd", "dist", "depot"))
def o16(spark, sf_dir):
    t = _terms(spark, sf_dir).withColumn("T", E.dispatch_interval(F.col("linehaul_km") + F.col("odd_cost"), F.col("alpha"), F.lit(ARRIVALS), F.lit(WR)))
    return t.select("district", R6(F.col("linehaul_km") / F.col("T"), "linehaul_per_h"), R6(F.col("odd_cost") / F.col("T"), "odd_per_h"), R6(E.tour_km(F.col("alpha"), F.lit(ARRIVALS), F.col("T")) / F.col("T"), "travel_per_h"), R6(ARRIVALS * WR * F.col("mass") * F.col("T") / 2, "waiting_per_h"))


@query("o19_route_partition", sql("select route, count(*)::bigint as n_blocks, round(sum(coalesce(p, 0)), 6) as mass from (select block, arg_min(route, (round(sqrt((b.x_km - s.x_km) ** 2 + (b.y_km - s.y_km) ** 2), 9), route, seq)) as route from blocks b, stops s group by block) left join demand using (block) group by route", "blocks", "stops", "demand"))
def o19(spark, sf_dir):
    """Blocks belong to the route of their nearest stop."""
    from dispatchgrid.operators.nearest import nearest

    r = Region(spark, sf_dir)
    near = nearest(r.blocks(), r.stops().withColumn("rank", F.struct("route", "seq")), "block", "rank").select("block", F.col("pick.route").alias("route"))
    return near.join(r.demand(), "block", "left").groupBy("route").agg(F.count("*").alias("n_blocks"), R6(F.sum(F.coalesce("p", F.lit(0.0))), "mass"))


@query("o21_pareto_sweep", sql(TERMS_SQL + f""", w as (select i / 10.0 as theta, (1 - i / 10.0) / (i / 10.0) as wr from (select unnest(range(1, 10)) as i)), g as (select theta, T, sum((linehaul_km + odd_cost + {E.TOUR_CONSTANT} * sqrt({ARRIVALS} * T) * alpha) / T) as provider, sum(mass * T / 2) as wait, any_value(wr) as wr from terms, w, (values (0.1::double), (0.25), (0.5), (1.0), (1.5)) t(T) group by theta, T)
select round(theta, 6) as theta, arg_min(T, (round(provider + {ARRIVALS} * wr * wait, 9), T)) as T, round(min(provider + {ARRIVALS} * wr * wait), 6) as cost from g group by theta""", "blocks", "demand", "odd", "dist", "depot"))
def o21(spark, sf_dir):
    """For each trade-off theta, the interval that is cheapest with riders weighted by (1 - theta) / theta."""
    grid = spark.range(1, 10).select((F.col("id") / 10.0).alias("theta")).withColumn("wr", (1 - F.col("theta")) / F.col("theta")).select("*", F.explode(F.array(*map(F.lit, (0.1, 0.25, 0.5, 1.0, 1.5)))).alias("T"))
    x = _terms(spark, sf_dir).crossJoin(F.broadcast(grid))
    provider = F.sum((F.col("linehaul_km") + F.col("odd_cost") + E.tour_km(F.col("alpha"), F.lit(ARRIVALS), F.col("T"))) / F.col("T"))
    g = x.groupBy("theta", "T").agg((provider + ARRIVALS * F.first("wr") * F.sum(F.col("mass") * F.col("T") / 2)).alias("cost"))
    return g.groupBy("theta").agg(F.min_by("T", F.struct(F.round("cost", 9), "T")).alias("T"), R6(F.min("cost"), "cost")).withColumn("theta", F.round("theta", 6))


@query("o9_on_demand", sql("with d as (select sum(p * sqrt((x_km - 2) ** 2 + (y_km - 2) ** 2)) as km from demand join blocks using (block)), f as (select unnest(range(1, ceil(150 * 2 * km / 30.0 / 0.85)::bigint + 2)) as v, km from d) select min(v)::bigint as fleet, round(any_value(150 * 2 * km), 6) as km_per_h from f where 150 * 2 * km / 30.0 / v <= 0.85", "demand", "blocks"))
def o9(spark, sf_dir):
    """Every rider alone from the depot: the smallest fleet at most 85 in 100 busy, and the km driven an hour."""
    r = Region(spark, sf_dir)
    d = r.demand().join(r.blocks(), "block").agg(F.sum(F.col("p") * E.distance(F.col("x_km"), F.col("y_km"), F.lit(2.0), F.lit(2.0))).alias("km"))
    f = d.select("km", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(150 * 2 * F.col("km") / 30.0 / 0.85) + 1)).alias("v")).where(150 * 2 * F.col("km") / 30.0 / F.col("v") <= 0.85)
    return f.agg(F.min("v").alias("fleet"), R6(F.first(150 * 2 * F.col("km")), "km_per_h"))
