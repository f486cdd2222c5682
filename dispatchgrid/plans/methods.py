"""Service methods behind one interface, a registry of them by setting, and sweeps over settings.

A method designs on a Region and evaluates a design to one row of costs; both return DataFrames. A method that simulates
sets `simulates`; one with routes of its own may give tours and walks that replace the evaluator's (`tour_override`,
`walk_h`). The difficulty cost is an injected expression over the feature columns.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchgrid.functions import exprs as E
from dispatchgrid.plans.region import ODD_WEIGHTS, Region


def linear_difficulty(*weights: float) -> Callable[..., Column]:
    """A cost that is linear in a district's features; missing and negative ones count as 0."""

    def cost(*features: Column) -> Column:
        parts = [w * F.greatest(F.coalesce(f, F.lit(0.0)), F.lit(0.0)) for w, f in zip(weights, features, strict=True)]
        return sum(parts[1:], parts[0])

    return cost


@dataclass
class Design:
    """block, root of each block; T of each root where the method fixes it; overrides; what else the method notes."""

    name: str
    assignment: DataFrame
    depot: int
    intervals: DataFrame | None = None
    tour_override: DataFrame | None = None
    walk_h: float = 0.0
    notes: dict = field(default_factory=dict)


RESULT = ("linehaul_cost", "odd_cost", "travel_cost", "fleet", "raw_fleet", "wait_h", "ride_h", "walk_h", "provider_cost", "user_cost", "total_cost")


def shared_evaluator(r: Region, d: Design, arrivals: float, wr: float, fleet_rate: float = 4.0, difficulty: Callable[..., Column] | None = None, interval: float | None = None) -> DataFrame:
    """One row of RESULT for a design: a fixed interval goes before the design's, which goes before the best one; a tour that
    the design gives goes before the estimate from the demand."""
    difficulty = difficulty or linear_difficulty(*ODD_WEIGHTS)
    from_depot = r.distances().where(F.col("src") == d.depot).select(F.col("dst").alias("block"), "km")
    p = F.coalesce("p", F.lit(0.0))
    rows = d.assignment.select("block", "root").join(r.blocks().select("block", "area_km2"), "block").join(r.demand(), "block", "left").join(r.odd(), "block", "left").join(from_depot, "block")
    t = rows.groupBy("root").agg(F.min("km").alias("linehaul_km"), difficulty(F.max("omega1"), F.max("omega2")).alias("odd"), F.sum(p).alias("mass"), F.sum(F.sqrt(p) * F.sqrt("area_km2")).alias("alpha"))
    best = E.dispatch_interval(F.col("linehaul_km") + F.col("odd"), F.col("alpha"), F.lit(arrivals), F.lit(wr))
    if d.intervals is not None:
        t = t.join(d.intervals.select("root", F.col("T").alias("own")), "root", "left")
    else:
        t = t.withColumn("own", F.lit(None).cast("double"))
    t = t.withColumn("T", F.lit(interval) if interval is not None else F.coalesce("own", best))
    tour = E.tour_km(F.col("alpha"), F.lit(arrivals), F.col("T"))
    if d.tour_override is not None:
        t = t.join(d.tour_override.select("root", F.col("km").alias("given")), "root", "left").withColumn("tour", F.coalesce("given", tour))
    else:
        t = t.withColumn("tour", tour)
    amortised, whole = E.fleet_sizes(2 * F.col("linehaul_km") + F.col("tour"), F.col("T"))
    mass = F.greatest(F.sum("mass"), F.lit(1e-12))
    mean = lambda c: F.sum(F.col("mass") * c) / mass
    out = t.select("*", amortised.alias("f"), whole.alias("n")).agg(
        F.sum(F.col("linehaul_km") / F.col("T")).alias("linehaul_cost"), F.sum(F.col("odd") / F.col("T")).alias("odd_cost"), F.sum(F.col("tour") / F.col("T")).alias("travel_cost"), F.sum("f").alias("fleet"), F.sum("n").alias("raw_fleet"),
        mean(F.col("T") / 2).alias("wait_h"), mean((F.col("linehaul_km") + F.col("tour") / 2) / E.SPEED_KMH).alias("ride_h"), F.lit(float(d.walk_h)).alias("walk_h"), F.sum("mass").alias("mass"),
    )
    out = out.withColumn("provider_cost", F.col("linehaul_cost") + F.col("odd_cost") + F.col("travel_cost") + fleet_rate * F.col("raw_fleet"))
    out = out.withColumn("user_cost", wr * (F.col("wait_h") + F.col("ride_h") + F.col("walk_h")) * F.col("mass")).withColumn("total_cost", F.col("provider_cost") + arrivals * F.col("user_cost"))
    return out.select(*(F.round(c, 6).alias(c) for c in RESULT))


class Method(ABC):
    """What a service mode must offer."""

    name: str
    simulates = False

    @abstractmethod
    def design(self, r: Region, arrivals: float, wr: float) -> Design: ...

    def evaluate(self, r: Region, d: Design, arrivals: float, wr: float) -> DataFrame:
        return shared_evaluator(r, d, arrivals, wr)


class Joint(Method):
    """Districts and intervals together; `radius` makes it robust, `interval` fixes one for all."""

    def __init__(self, name: str = "joint", districts: int = 5, restarts: int = 4, radius: float = 0.0, interval: float | None = None):
        self.name, self.districts, self.restarts, self.radius, self.interval = name, districts, restarts, radius, interval

    def design(self, r: Region, arrivals: float, wr: float) -> Design:
        from dispatchgrid.operators.partition import best_partition

        best = best_partition(r, self.districts, self.restarts, radius=self.radius, arrivals=arrivals, wr=wr, fixed_interval=self.interval)
        rows = best.select("block", "root", "depot", "T").toPandas()  # one row a block of the region
        given = r.spark.createDataFrame(rows)
        return Design(self.name, given.select("block", "root"), int(rows.depot.iloc[0]), given.select("root", "T").distinct())


class Strips(Method):
    """Vertical strips, each served along a fixed route with one interval."""

    name = "strips"

    def __init__(self, strips: int = 3, interval: float = 0.5):
        self.strips, self.interval = strips, interval

    def design(self, r: Region, arrivals: float, wr: float) -> Design:
        b = r.blocks()
        width = b.agg(((F.max("x_km") - F.min("x_km")) / self.strips).alias("w"), F.min("x_km").alias("lo"))
        s = b.crossJoin(F.broadcast(width)).withColumn("strip", F.least(F.lit(self.strips - 1), F.floor((F.col("x_km") - F.col("lo")) / F.col("w"))))
        members = F.array_sort(F.collect_list("block"))
        roots = s.groupBy("strip").agg(F.get(members, F.floor(F.count("*") / 2).cast("int")).alias("root"))
        a = s.join(roots, "strip").select("block", "root")
        return Design(self.name, a, r.depot().first()["depot"], roots.select("root", F.lit(self.interval).alias("T")), notes={"strips": self.strips})


class OnDemand(Method):
    """Every rider alone; the fleet that costs least with the queue before it."""

    name, simulates = "on_demand", True

    def design(self, r: Region, arrivals: float, wr: float) -> Design:
        depot = r.depot().first()["depot"]
        return Design(self.name, r.blocks().select("block", F.lit(depot).alias("root")), depot)

    def evaluate(self, r: Region, d: Design, arrivals: float, wr: float) -> DataFrame:
        from dispatchgrid.operators.on_demand import fleet_costs

        c = fleet_costs(r, arrivals, wr)
        best = c.agg(F.min_by(F.struct("fleet", "km_per_h", "wait_h", "ride_h", "provider_cost"), F.struct("total_cost", "fleet")).alias("b")).select("b.*")
        zero = lambda name: F.lit(0.0).alias(name)
        user = wr * (F.col("wait_h") + F.col("ride_h"))
        return best.select(zero("linehaul_cost"), zero("odd_cost"), F.col("km_per_h").alias("travel_cost"), F.round(F.col("km_per_h") / E.SPEED_KMH, 6).alias("fleet"), F.col("fleet").cast("double").alias("raw_fleet"), "wait_h", "ride_h", zero("walk_h"), "provider_cost", F.round(user, 6).alias("user_cost"), F.round(F.col("provider_cost") + arrivals * user, 6).alias("total_cost"))


#: Methods by the mode that a setting names.
REGISTRY: dict[str, Callable[[dict], Method]] = {
    "joint": lambda s: Joint("joint", s.get("districts", 5)),
    "joint_robust": lambda s: Joint("joint_robust", s.get("districts", 5), 1, s.get("radius", 0.5)),
    "spatial_only": lambda s: Joint("spatial_only", s.get("districts", 5), 4, 0.0, s.get("interval", 0.25)),
    "strips": lambda s: Strips(s.get("strips", 3), s.get("interval", 0.5)),
    "on_demand": lambda s: OnDemand(),
}


def make_method(setting: dict) -> Method:
    """The method of a setting; ValueError names the modes there are."""
    if setting.get("mode") not in REGISTRY:
        raise ValueError(f"mode {setting.get('mode')!r} is none of {', '.join(sorted(REGISTRY))}")
    return REGISTRY[setting["mode"]](setting)


def sweep(r: Region, settings: list[dict]) -> DataFrame:
    """mode, arrivals_h, wr, status and RESULT of each setting; a setting that fails gives a row with its error as status."""
    out = None
    for s in settings:
        label = [F.lit(s.get("mode")).alias("mode"), F.lit(float(s.get("arrivals", 150))).alias("arrivals_h"), F.lit(float(s.get("wr", 1))).alias("wr")]
        try:
            m = make_method(s)
            d = m.design(r, float(s.get("arrivals", 150)), float(s.get("wr", 1)))
            row = m.evaluate(r, d, float(s.get("arrivals", 150)), float(s.get("wr", 1))).select(*label, F.lit("ok").alias("status"), *RESULT)
        except (ValueError, RuntimeError) as error:
            row = r.spark.range(1).select(*label, F.lit(f"failed: {error}").alias("status"), *(F.lit(None).cast("double").alias(c) for c in RESULT))
        out = row if out is None else out.unionByName(row)
    return out
