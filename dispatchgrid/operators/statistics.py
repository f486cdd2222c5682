"""Regression, tests, outlier filters and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.distributions import t_two_sided
from dispatchgrid.functions.medians import exact_medians
from dispatchgrid.functions import exprs as E
from dispatchgrid.operators.evaluate import ARRIVALS, TERMS_SQL, WR, _terms, newton_sql
from dispatchgrid.plans.region import Region, sql

R6 = lambda c, n: F.round(c, 6).alias(n)


@query("p1_least_squares", sql("select round(regr_slope(o_totalprice, o_custkey), 6) as slope, round(regr_intercept(o_totalprice, o_custkey), 4) as intercept, round(regr_r2(o_totalprice, o_custkey), 6) as r2 from orders"))
def p1(spark, sf_dir):
    return Region(spark, sf_dir).table("orders").agg(R6(F.regr_slope("o_totalprice", "o_custkey"), "slope"), F.round(F.regr_intercept("o_totalprice", "o_custkey"), 4).alias("intercept"), R6(F.regr_r2("o_totalprice", "o_custkey"), "r2"))


@query("p2_two_sample_t", sql("""with s as (select o_orderstatus = 'F' as f, avg(o_totalprice) as m, var_samp(o_totalprice) as v, count(*) as n from orders where o_orderstatus in ('F', 'O') group by 1)
select round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) as t, (a.n + b.n - 2)::bigint as df from s a, s b where a.f and not b.f"""))
def p2(spark, sf_dir):
    """Pooled-variance t statistic, both samples in one aggregation."""
    o = Region(spark, sf_dir).table("orders").where("o_orderstatus in ('F', 'O')")
    of = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))
    a = o.agg(*(f(of(s)).alias(f"{n}_{s}") for s in "FO" for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    df = F.col("n_F") + F.col("n_O") - 2
    pooled = ((F.col("n_F") - 1) * F.col("v_F") + (F.col("n_O") - 1) * F.col("v_O")) / df
    return a.select(R6((F.col("m_F") - F.col("m_O")) / F.sqrt(pooled * (1 / F.col("n_F") + 1 / F.col("n_O"))), "t"), df.alias("df"))


@query("p2_two_sample_p", """with s as (select o_orderpriority as g, o_orderstatus = 'F' as f, avg(o_totalprice) as m, var_samp(o_totalprice) as v, count(*) as n from orders where o_orderstatus in ('F', 'O') group by all having count(*) > 1),
t as (select a.g, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) as t, (a.n + b.n - 2)::double as df from s a, s b where a.g = b.g and a.f and not b.f),
w as (select g, t, df, i, case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * pow(1 + pow(abs(t) * i / 4000, 2) / df, -(df + 1) / 2) as y from t, (select unnest(range(4001)) as i))
select g, round(t, 6) as t, df::bigint as df, round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * sum(y) * abs(t) / 12000, 6) as p from w group by g, t, df""")
def p2_p(spark, sf_dir):
    """The t statistic of each priority's finished against open orders, and its two-sided chance by the incomplete beta function."""
    o = Region(spark, sf_dir).table("orders").where("o_orderstatus in ('F', 'O')")
    of = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))
    a = o.groupBy(F.col("o_orderpriority").alias("g")).agg(*(f(of(s)).alias(f"{n}_{s}") for s in "FO" for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)))).where("n_F > 1 and n_O > 1")
    df = F.col("n_F") + F.col("n_O") - 2
    pooled = ((F.col("n_F") - 1) * F.col("v_F") + (F.col("n_O") - 1) * F.col("v_O")) / df
    a = a.select("g", ((F.col("m_F") - F.col("m_O")) / F.sqrt(pooled * (1 / F.col("n_F") + 1 / F.col("n_O")))).alias("t"), df.alias("df"))
    return a.select("g", R6("t", "t"), "df", R6(t_two_sided(F.col("t"), F.col("df")), "p"))


@query("p4_root_density_integral", sql(f"select round(avg(sqrt(greatest(0, 1.5 - u))), 6) as integral from (select {E.uniform_sql('i', 'mc')} as u from (select o_orderkey as i from orders))"))
def p4(spark, sf_dir):
    u = E.hash_uniform(F.col("o_orderkey"), "mc")
    return Region(spark, sf_dir).table("orders").agg(R6(F.avg(F.sqrt(F.greatest(F.lit(0.0), 1.5 - u))), "integral"))


@query("p5_interval_curve", sql(f"select round(n * 0.25, 6) as alpha, round({newton_sql('4.0', '(n * 0.25)', str(ARRIVALS), str(WR))}, 6) as T from (select distinct p_size::double as n from part)"))
def p5(spark, sf_dir):
    """The optimal interval over a range of tour coefficients."""
    a = Region(spark, sf_dir).table("part").select((F.col("p_size") * 0.25).alias("alpha")).distinct()
    return a.select(R6("alpha", "alpha"), R6(E.dispatch_interval(F.lit(4.0), F.col("alpha"), F.lit(ARRIVALS), F.lit(WR)), "T"))


@query("p6_outlier_filter", sql("""with l as (select o_orderpriority as g, o_orderkey, log10(o_totalprice) as v, count(*) over (partition by o_orderpriority) as n, median(log10(o_totalprice)) over (partition by o_orderpriority) as m from orders where o_totalprice > 0),
d as (select *, median(abs(v - m)) over (partition by g) as mad from l), k as (select *, (n < 5 or mad = 0 or 0.6745 * abs(v - m) / mad <= 3.5) as ok from d)
select g, count(*)::bigint as kept from (select *, sum(ok::int) over (partition by g) as n_ok from k) where ok or n_ok < greatest(3, n - 2) and n < 10 group by g"""))
def p6(spark, sf_dir):
    """Modified z-scores on logs; a small group that would lose more than two rows keeps all."""
    o = Region(spark, sf_dir).table("orders").where("o_totalprice > 0").select(F.col("o_orderpriority").alias("g"), F.log10("o_totalprice").alias("v"))
    middle = exact_medians(o, F.col("v"), F.col("g")).select(F.col("key").alias("g"), F.col("median").alias("m"))
    o = o.join(o.groupBy("g").agg(F.count("*").alias("n")), "g").join(middle, "g").withColumn("d", F.abs(F.col("v") - F.col("m")))
    o = o.join(exact_medians(o, F.col("d"), F.col("g")).select(F.col("key").alias("g"), F.col("median").alias("mad")), "g")
    o = o.withColumn("ok", (F.col("n") < 5) | (F.col("mad") == 0) | (0.6745 * F.col("d") / F.nullif("mad", F.lit(0.0)) <= 3.5))
    c = o.groupBy("g").agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n"))
    return c.select("g", F.when((F.col("n_ok") < F.greatest(F.lit(3), F.col("n") - 2)) & (F.col("n") < 10), F.col("n")).otherwise(F.col("n_ok")).alias("kept"))


@query("p8_two_deviations", sql("select o_orderstatus as s, round(stddev_pop(o_totalprice), 4) as pop, round(stddev_samp(o_totalprice), 4) as samp from orders group by 1"))
def p8(spark, sf_dir):
    return Region(spark, sf_dir).table("orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.round(F.stddev_pop("o_totalprice"), 4).alias("pop"), F.round(F.stddev_samp("o_totalprice"), 4).alias("samp"))


@query("p9_timing_regression", sql("select round(regr_slope(l_extendedprice, l_quantity), 6) as per_unit, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem"))
def p9(spark, sf_dir):
    return Region(spark, sf_dir).table("lineitem").agg(R6(F.regr_slope("l_extendedprice", "l_quantity"), "per_unit"), R6(F.regr_r2("l_extendedprice", "l_quantity"), "r2"))


@query("p10_capped_rollup", sql(TERMS_SQL + f""", t as (select *, least(1.5, {newton_sql("(linehaul_km + odd_cost)", "alpha", str(ARRIVALS), str(WR))}) as T from terms)
select round(max(T + {E.TOUR_CONSTANT} * sqrt({ARRIVALS} * T) * alpha / {E.SPEED_KMH}), 6) as worst_total_h, round(sum(mass * T / 2) / greatest(sum(mass), 1e-12), 6) as mean_wait_h from t""", "blocks", "demand", "odd", "dist", "depot"))
def p10(spark, sf_dir):
    t = _terms(spark, sf_dir).withColumn("T", F.least(F.lit(1.5), E.dispatch_interval(F.col("linehaul_km") + F.col("odd_cost"), F.col("alpha"), F.lit(ARRIVALS), F.lit(WR))))
    worst = F.max(F.col("T") + E.tour_km(F.col("alpha"), F.lit(ARRIVALS), F.col("T")) / E.SPEED_KMH)
    return t.agg(R6(worst, "worst_total_h"), R6(F.sum(F.col("mass") * F.col("T") / 2) / F.greatest(F.sum("mass"), F.lit(1e-12)), "mean_wait_h"))


@query("p11_local_constant", sql("select round(sum(secs) / (sqrt(count(*)) * 210), 6) as beta from stops", "stops"))
def p11(spark, sf_dir):
    """The constant of a service from its length, its stops and its area."""
    return Region(spark, sf_dir).stops().agg(R6(F.sum("secs") / (F.sqrt(F.count("*")) * 210), "beta"))


@query("o18_population_demand", sql("select c_custkey as block, round(case when sum(w) over () > 0 then w / sum(w) over () else 1.0 / count(*) over () end, 9) as p from (select c_custkey, greatest(c_acctbal, 0) as w from customer)"))
def o18(spark, sf_dir):
    """Demand in proportion to population, uniform where there is none."""
    w = F.greatest("c_acctbal", F.lit(0.0))
    c = Region(spark, sf_dir).table("customer")
    total = c.agg(F.sum(w).alias("total"), F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(total)).select(F.col("c_custkey").alias("block"), F.round(F.when(F.col("total") > 0, w / F.col("total")).otherwise(1 / F.col("n")), 9).alias("p"))


@query("s9_edge_grade", sql("select route, seq, round(case when km is null or km = 0 then 0 else abs((x_km - px) * 3 + (y_km - py) * 2) / (km * 1000) end, 9) as grade from (select route, seq, x_km, y_km, lag(x_km) over w as px, lag(y_km) over w as py, sqrt((x_km - lag(x_km) over w) ** 2 + (y_km - lag(y_km) over w) ** 2) as km from stops window w as (partition by route order by seq))", "stops"))
def s9(spark, sf_dir):
    """Absolute rise over length between consecutive stops on a tilted plane of 3 m and 2 m per km."""
    w = Window.partitionBy("route").orderBy("seq")
    x, y = F.col("x_km"), F.col("y_km")
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    km = E.distance(x, y, px, py)
    grade = F.when(km.isNull() | (km == 0), 0.0).otherwise(F.abs((x - px) * 3 + (y - py) * 2) / (km * 1000))
    return Region(spark, sf_dir).stops().select("route", "seq", F.round(grade, 9).alias("grade"))


@query("s26_county_groups", sql("select n_regionkey as county, string_agg(n_nationkey::varchar, ',' order by n_nationkey) as geoids, coalesce(sum(n), 0)::bigint as pop from nation left join (select c_nationkey, count(*) as n from customer group by 1) on c_nationkey = n_nationkey group by 1"))
def s26(spark, sf_dir):
    r = Region(spark, sf_dir)
    c = r.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    j = r.table("nation").join(c, "n_nationkey", "left")
    ids = F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string"))
    return j.groupBy(F.col("n_regionkey").alias("county")).agg(F.array_join(ids, ",").alias("geoids"), F.coalesce(F.sum("n"), F.lit(0)).alias("pop"))
