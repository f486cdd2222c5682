"""The region as DataFrames (blocks, demand, difficulty, districts, distances, ...) over the driver's tables, and the same
views as SQL.

Raw tables are aggregated to one row per block before anything is joined, so what meets afterwards has the size of the
region, not of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchgrid.functions.exprs import distance

#: Weights of the linear difficulty cost of a district.
ODD_WEIGHTS = (0.6, 0.4)


class Region:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def blocks(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.alias("block"), (n % 5).cast("double").alias("x_km"), F.floor(n / 5).cast("double").alias("y_km"), F.lit(1.0).alias("area_km2"), F.col("n_regionkey").alias("district")
        )

    def demand(self) -> DataFrame:
        """Share of orders by the customer's block; blocks without orders are absent."""
        per = self.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
        per = per.join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("block")).agg(F.sum("n").alias("n"))
        return per.select("block", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))

    def odd(self) -> DataFrame:
        """Two difficulty features of each block, 0 to 5."""
        c = self.table("customer").groupBy(F.col("c_nationkey").alias("block")).agg(F.count("*").alias("customers"))
        s = self.table("supplier").groupBy(F.col("s_nationkey").alias("block")).agg(F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("balance"))
        b = self.blocks().select("block").join(c, "block", "left").join(s, "block", "left").fillna(0)
        return b.select("block", (5 * minmax("customers")).alias("omega1"), (5 * (0.5 * minmax("suppliers") + 0.5 * minmax("balance"))).alias("omega2"))

    def distances(self) -> DataFrame:
        a = self.blocks().select(F.col("block").alias("src"), F.col("x_km").alias("x1"), F.col("y_km").alias("y1"))
        b = self.blocks().select(F.col("block").alias("dst"), F.col("x_km").alias("x2"), F.col("y_km").alias("y2"))
        return a.crossJoin(b).select("src", "dst", distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("km"))

    def edges(self) -> DataFrame:
        """Rook neighbours, both directions."""
        a = self.blocks().select(F.col("block").alias("src"), "x_km", "y_km")
        steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)))))
        a = a.select("src", "x_km", "y_km", steps.alias("s")).select("src", (F.col("x_km") + F.col("s.dx")).alias("x_km"), (F.col("y_km") + F.col("s.dy")).alias("y_km"))
        return a.join(self.blocks().select(F.col("block").alias("dst"), "x_km", "y_km"), ["x_km", "y_km"]).select("src", "dst", F.lit(1.0).alias("km"))

    def depot(self) -> DataFrame:
        """The block nearest to the mean position."""
        m = Window.partitionBy()
        d = distance(F.col("x_km"), F.col("y_km"), F.avg("x_km").over(m), F.avg("y_km").over(m))
        return self.blocks().select("block", d.alias("d")).agg(F.min(F.struct("d", "block")).alias("m")).select(F.col("m.block").alias("depot"))

    def stops(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("stop"), ((k * 7919) % 500 / 100.0).alias("x_km"), ((k * 104729) % 500 / 100.0).alias("y_km"), (F.col("s_nationkey") % 3).alias("route"), (30 + k % 90).cast("long").alias("secs")
        ).withColumn("seq", F.row_number().over(Window.partitionBy("route").orderBy("stop")))


def minmax(c: str):
    """Scaled to 0..1 over all rows; 0 where all are equal."""
    w = Window.partitionBy()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))


VIEWS = {
    "blocks": "select n_nationkey as block, (n_nationkey % 5)::double as x_km, (n_nationkey // 5)::double as y_km, 1.0::double as area_km2, n_regionkey as district from nation",
    "demand": "select c_nationkey as block, count(*)::double / (select count(*) from orders join customer on o_custkey = c_custkey) as p from orders join customer on o_custkey = c_custkey group by c_nationkey",
    "odd_counts": "select block, coalesce((select count(*) from customer where c_nationkey = block), 0)::double as customers, coalesce((select count(*) from supplier where s_nationkey = block), 0)::double as suppliers, coalesce((select sum(s_acctbal) from supplier where s_nationkey = block), 0)::double as balance from blocks",
    "odd": "select block, 5 * (customers - min(customers) over ()) / nullif(max(customers) over () - min(customers) over (), 0) as omega1, 5 * (0.5 * (suppliers - min(suppliers) over ()) / nullif(max(suppliers) over () - min(suppliers) over (), 0) + 0.5 * (balance - min(balance) over ()) / nullif(max(balance) over () - min(balance) over (), 0)) as omega2 from odd_counts",
    "dist": "select a.block as src, b.block as dst, sqrt((a.x_km - b.x_km) * (a.x_km - b.x_km) + (a.y_km - b.y_km) * (a.y_km - b.y_km)) as km from blocks a, blocks b",
    "edges": "select a.block as src, b.block as dst, 1.0::double as km from blocks a, blocks b where abs(a.x_km - b.x_km) + abs(a.y_km - b.y_km) = 1",
    "depot": "select arg_min(block, (d, block)) as depot from (select block, sqrt((x_km - avg(x_km) over ()) ** 2 + (y_km - avg(y_km) over ()) ** 2) as d from blocks)",
    "stops": "select s_suppkey as stop, (s_suppkey * 7919) % 500 / 100.0::double as x_km, (s_suppkey * 104729) % 500 / 100.0::double as y_km, s_nationkey % 3 as route, (30 + s_suppkey % 90)::bigint as secs, row_number() over (partition by s_nationkey % 3 order by s_suppkey) as seq from supplier",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """A query over some of the views, with those they need in turn."""
    needs = {"odd": ["blocks", "odd_counts"], "odd_counts": ["blocks"], "dist": ["blocks"], "edges": ["blocks"], "depot": ["blocks"]}
    order: list[str] = []
    for v in views:
        for n in [*needs.get(v, []), v]:
            if n not in order:
                order.append(n)
    ctes = ",\n".join(f"{v} as ({VIEWS[v]})" for v in order)
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        body = body[5:]
        return f"with {'recursive ' if recursive else ''}{ctes},\n{body}"
    return f"with {ctes}\n{body}"
