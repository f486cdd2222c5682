"""The standard evaluator: district costs, dispatch intervals, fleets and their demand-weighted roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions import exprs as E
from dispatchgrid.plans.region import ODD_WEIGHTS, Region, sql

ARRIVALS, WR, FLEET_RATE, INTERVAL = 150.0, 1.0, 4.0, 0.5
_J = f"({ODD_WEIGHTS[0]} * coalesce(max(omega1), 0) + {ODD_WEIGHTS[1]} * coalesce(max(omega2), 0))"


def district_terms(assignment: DataFrame, demand: DataFrame, odd: DataFrame, dist: DataFrame, depot: DataFrame) -> DataFrame:
    """Per district: linehaul km from the depot to its nearest block, difficulty cost, mass and tour coefficient.

    assignment: block, district, area_km2; demand: block, p (absent is 0); odd: block, omega1, omega2; dist: src, dst, km.
    """
    from_depot = dist.join(F.broadcast(depot), dist.src == depot.depot).select(F.col("dst").alias("block"), "km")
    p = F.coalesce("p", F.lit(0.0))
    rows = assignment.join(demand, "block", "left").join(odd, "block", "left").join(from_depot, "block")
    worst = [F.greatest(F.coalesce(F.max(f"omega{i + 1}"), F.lit(0.0)), F.lit(0.0)) * w for i, w in enumerate(ODD_WEIGHTS)]
    return rows.groupBy("district").agg(
        F.min("km").alias("linehaul_km"), sum(worst[1:], worst[0]).alias("odd_cost"), F.sum(p).alias("mass"), F.sum(F.sqrt(p) * F.sqrt("area_km2")).alias("alpha")
    )


def evaluate_design(terms: DataFrame, interval, arrivals: float = ARRIVALS, wr: float = WR, fleet_rate: float = FLEET_RATE) -> DataFrame:
    """One row of costs and times for a design; interval is a column or expression over district_terms."""
    d = terms.withColumn("T", interval)
    d = d.withColumn("tour_km", E.tour_km(F.col("alpha"), F.lit(arrivals), F.col("T")))
    km = 2 * F.col("linehaul_km") + F.col("tour_km")
    amortised, whole = E.fleet_sizes(km, F.col("T"))
    d = d.withColumn("fleet", amortised).withColumn("raw_fleet", whole)
    mass = F.greatest(F.sum("mass"), F.lit(1e-12))
    weighted = lambda c: F.sum(F.col("mass") * c) / mass
    out = d.agg(
        F.sum(F.col("linehaul_km") / F.col("T")).alias("linehaul_cost"),
        F.sum(F.col("odd_cost") / F.col("T")).alias("odd_cost"),
        F.sum(F.col("tour_km") / F.col("T")).alias("travel_cost"),
        F.sum("fleet").alias("fleet"),
        F.sum("raw_fleet").alias("raw_fleet"),
        weighted(F.col("T") / 2).alias("wait_h"),
        weighted((F.col("linehaul_km") + F.col("tour_km") / 2) / E.SPEED_KMH).alias("ride_h"),
        F.sum("mass").alias("served_mass"),
    )
    provider = F.col("linehaul_cost") + F.col("odd_cost") + F.col("travel_cost") + fleet_rate * F.col("raw_fleet")
    user = wr * (F.col("wait_h") + F.col("ride_h"))
    out = out.withColumn("provider_cost", provider).withColumn("user_cost", user * F.col("served_mass"))
    out = out.withColumn("total_cost", F.col("provider_cost") + arrivals * F.col("user_cost"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def _terms(spark, sf_dir) -> DataFrame:
    r = Region(spark, sf_dir)
    return district_terms(r.blocks(), r.demand(), r.odd(), r.distances(), r.depot())


TERMS_SQL = f"""with terms as (select district, min(km) as linehaul_km, {_J} as odd_cost, sum(coalesce(p, 0)) as mass, sum(sqrt(coalesce(p, 0)) * sqrt(area_km2)) as alpha
from blocks left join demand using (block) left join odd using (block) join (select dst as block, km from dist, depot where src = depot) using (block) group by district)"""


def newton_sql(fixed: str, alpha: str, arrivals: str, wr: str) -> str:
    """The dispatch interval as a fold over a list, step by step as dispatch_interval."""
    c = f"greatest(0.1, least(10.0, pow({fixed} / greatest({wr}, 1e-9), 0.25)))"
    a1 = f"({E.TOUR_CONSTANT} * sqrt({arrivals}) * {alpha})"
    step = f"least(20.0, greatest(0.01, c - (-2 * {fixed} / pow(c, 3) - {a1} / pow(c, 2) + {wr} * {alpha} + 2 * {wr} * c) / greatest(6 * {fixed} / pow(c, 4) + 2 * {a1} / pow(c, 3) + 2 * {wr}, 1e-12)))"
    fold = f"list_reduce(list_prepend({c}, list_transform(range({E.NEWTON_STEPS}), lambda i: i::double)), lambda c, i: {step})"
    return f"pow({fold}, 2)"


def evaluation_sql(interval: str) -> str:
    return sql(
        TERMS_SQL
        + f""", d as (select *, {interval} as T from terms),
e as (select *, {E.TOUR_CONSTANT} * sqrt({ARRIVALS} * T) * alpha as tour_km from d),
f as (select *, case when 2 * linehaul_km + tour_km <= 0 then 0.0 else (2 * linehaul_km + tour_km) / ({E.SPEED_KMH} * T) end as fleet from e),
g as (select sum(linehaul_km / T) as linehaul_cost, sum(odd_cost / T) as odd_cost, sum(tour_km / T) as travel_cost, sum(fleet) as fleet, sum(ceil(greatest(fleet - 1e-12, 0)))::double as raw_fleet,
  sum(mass * T / 2) / greatest(sum(mass), 1e-12) as wait_h, sum(mass * (linehaul_km + tour_km / 2) / {E.SPEED_KMH}) / greatest(sum(mass), 1e-12) as ride_h, sum(mass) as served_mass from f),
h as (select *, linehaul_cost + odd_cost + travel_cost + {FLEET_RATE} * raw_fleet as provider_cost, {WR} * (wait_h + ride_h) * served_mass as user_cost from g)
select round(linehaul_cost, 6) as linehaul_cost, round(odd_cost, 6) as odd_cost, round(travel_cost, 6) as travel_cost, round(fleet, 6) as fleet, round(raw_fleet, 6) as raw_fleet, round(wait_h, 6) as wait_h,
  round(ride_h, 6) as ride_h, round(served_mass, 6) as served_mass, round(provider_cost, 6) as provider_cost, round(user_cost, 6) as user_cost, round(provider_cost + {ARRIVALS} * user_cost, 6) as total_cost from h""",
        "blocks", "demand", "odd", "dist", "depot",
    )


@query("o1_evaluate_design", evaluation_sql(f"{INTERVAL}::double"))
def o1(spark, sf_dir):
    return evaluate_design(_terms(spark, sf_dir), F.lit(INTERVAL))


def _newton():
    return E.dispatch_interval(F.col("linehaul_km") + F.col("odd_cost"), F.col("alpha"), F.lit(ARRIVALS), F.lit(WR))


@query("o5_newton_design", evaluation_sql(newton_sql("(linehaul_km + odd_cost)", "alpha", str(ARRIVALS), str(WR))))
def o5(spark, sf_dir):
    return evaluate_design(_terms(spark, sf_dir), _newton())


@query("d14_district_mass", sql("select district, round(sum(coalesce(p, 0)), 6) as mass from blocks left join demand using (block) group by district", "blocks", "demand"))
def d14(spark, sf_dir):
    return _terms(spark, sf_dir).select("district", F.round("mass", 6).alias("mass"))


@query("d15_tour_coefficient", sql("select district, round(sum(sqrt(coalesce(p, 0)) * sqrt(area_km2)), 6) as alpha from blocks left join demand using (block) group by district", "blocks", "demand"))
def d15(spark, sf_dir):
    return _terms(spark, sf_dir).select("district", F.round("alpha", 6).alias("alpha"))


@query("d16_district_odd", sql(f"select district, round({_J}, 6) as odd_cost from blocks left join odd using (block) group by district", "blocks", "odd"))
def d16(spark, sf_dir):
    return _terms(spark, sf_dir).select("district", F.round("odd_cost", 6).alias("odd_cost"))


@query("d17_linehaul", sql("select district, round(min(km), 6) as linehaul_km from blocks join dist on dst = block join depot on src = depot group by district", "blocks", "dist", "depot"))
def d17(spark, sf_dir):
    return _terms(spark, sf_dir).select("district", F.round("linehaul_km", 6).alias("linehaul_km"))


_T = newton_sql("(linehaul_km + odd_cost)", "alpha", str(ARRIVALS), str(WR))


@query("h25_newton_interval", sql(TERMS_SQL + f" select district, round({_T}, 6) as T from terms", "blocks", "demand", "odd", "dist", "depot"))
def h25(spark, sf_dir):
    return _terms(spark, sf_dir).select("district", F.round(_newton(), 6).alias("T"))


@query("h26_subgradients", sql(TERMS_SQL + f""" , t as (select *, sqrt({_T}) as c from terms)
select district, round((linehaul_km + odd_cost) / (c * c) + {E.TOUR_CONSTANT} * sqrt({ARRIVALS}) * alpha / c + {WR} * alpha * c + {WR} * c * c, 6) as value,
 round({E.TOUR_CONSTANT} * sqrt({ARRIVALS}) / c + {WR} * c, 6) as by_alpha, round(1 / (c * c), 6) as by_fixed from t""", "blocks", "demand", "odd", "dist", "depot"))
def h26(spark, sf_dir):
    t = _terms(spark, sf_dir).withColumn("c", F.sqrt(_newton()))
    c, tour = F.col("c"), E.TOUR_CONSTANT * (ARRIVALS**0.5)
    value = (F.col("linehaul_km") + F.col("odd_cost")) / (c * c) + tour * F.col("alpha") / c + WR * F.col("alpha") * c + WR * c * c
    return t.select("district", F.round(value, 6).alias("value"), F.round(tour / c + WR * c, 6).alias("by_alpha"), F.round(1 / (c * c), 6).alias("by_fixed"))


@query("d21_minimax_district", sql(TERMS_SQL + f" select arg_max(district, (linehaul_km + odd_cost + {E.TOUR_CONSTANT * (ARRIVALS * INTERVAL) ** 0.5} * alpha, district)) as district, round(max(linehaul_km + odd_cost + {E.TOUR_CONSTANT * (ARRIVALS * INTERVAL) ** 0.5} * alpha), 6) as cost from terms", "blocks", "demand", "odd", "dist", "depot"))
def d21(spark, sf_dir):
    cost = F.col("linehaul_km") + F.col("odd_cost") + E.tour_km(F.col("alpha"), F.lit(ARRIVALS), F.lit(INTERVAL))
    return _terms(spark, sf_dir).agg(F.max_by("district", F.struct(cost.alias("c"), "district")).alias("district"), F.round(F.max(cost), 6).alias("cost"))


@query("o20_regime_sweep", sql(TERMS_SQL + f""", s as (select l::double as arrivals_h, w::double as wr from (values (50), (150), (300)) a(l), (values (1), (3), (10)) b(w)),
e as (select arrivals_h, wr, T, linehaul_km, odd_cost, mass, {E.TOUR_CONSTANT} * sqrt(arrivals_h * T) * alpha as tour_km from terms, s, (values (0.25::double), (0.5), (1.0), (2.0)) t(T)),
c as (select arrivals_h, wr, T, sum((linehaul_km + odd_cost + tour_km) / T) + arrivals_h * wr * sum(mass * (T / 2 + (linehaul_km + tour_km / 2) / {E.SPEED_KMH})) as cost from e group by arrivals_h, wr, T)
select arrivals_h, wr, arg_min(T, (cost, T)) as best_T, round(min(cost), 6) as cost from c group by arrivals_h, wr""", "blocks", "demand", "odd", "dist", "depot"))
def o20(spark, sf_dir):
    """Every setting of arrivals and rider weight against every interval; the cheapest interval of each."""
    grid = lambda name, *v: spark.range(1).select(F.explode(F.array(*map(F.lit, map(float, v)))).alias(name))
    settings = grid("arrivals_h", 50, 150, 300).crossJoin(grid("wr", 1, 3, 10)).crossJoin(grid("T", 0.25, 0.5, 1, 2))
    e = _terms(spark, sf_dir).crossJoin(F.broadcast(settings)).withColumn("tour_km", E.tour_km(F.col("alpha"), F.col("arrivals_h"), F.col("T")))
    user = F.col("mass") * (F.col("T") / 2 + (F.col("linehaul_km") + F.col("tour_km") / 2) / E.SPEED_KMH)
    c = e.groupBy("arrivals_h", "wr", "T").agg((F.sum((F.col("linehaul_km") + F.col("odd_cost") + F.col("tour_km")) / F.col("T")) + F.col("arrivals_h") * F.col("wr") * F.sum(user)).alias("cost"))
    return c.groupBy("arrivals_h", "wr").agg(F.min_by("T", F.struct("cost", "T")).alias("best_T"), F.round(F.min("cost"), 6).alias("cost"))
