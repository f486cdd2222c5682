"""Binary sources as queries: a table is written in the format by Spark's tasks and read back in several partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.kept import keep, shared_root
from dispatchgrid.operators import polygons as P
from dispatchgrid.plans.region import Region
from dispatchgrid.sources import formats

R6 = lambda c, n: F.round(c, 6).alias(n)


def folder(spark, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


_CELLS = "select c_custkey::varchar as id, ((c_custkey * 7919) % 997)::double / 10 as x, ((c_custkey * 104729) % 991)::double / 10 as y from customer"


@query("a1_polygon_shapes", f"with c as ({_CELLS}) select id, x as xmin, y + 0.5 as ymax, 2::bigint as n_rings, round(0.5 - 0.01, 6) as area from c where id in (select o_custkey::varchar from orders where o_orderkey <= 40) and x <= 60 and y >= 20")
def a1(spark, sf_dir):
    """Plots of customers with a hole each, written as shapefiles, one a task; of them the listed ids inside a box."""
    r, at = Region(spark, sf_dir), folder(spark, "shapes")
    formats.register(spark)
    k = F.col("c_custkey")
    x, y = (k * 7919) % 997 / 10.0, (k * 104729) % 991 / 10.0
    at_ = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    outer, hole = F.array(at_(0.0, 0.0), at_(0.0, 0.5), at_(1.0, 0.5), at_(1.0, 0.0), at_(0.0, 0.0)), F.array(at_(0.1, 0.1), at_(0.2, 0.1), at_(0.2, 0.2), at_(0.1, 0.2), at_(0.1, 0.1))
    r.table("customer").select(k.cast("string").alias("id"), F.array(outer, hole).alias("rings")).repartition(4).write.format("polygon_shapes").mode("append").save(at)
    ids = r.table("orders").where("o_orderkey <= 40").select(F.col("o_custkey").cast("string").alias("id")).distinct()
    shapes = spark.read.format("polygon_shapes").option("blockBytes", 1 << 16).load(at).where("xmin <= 60 and ymin >= 20")
    n = F.size("rings")
    twice = lambda ring: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda a, i: a + F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
    area = F.abs(F.aggregate(F.transform("rings", twice), F.lit(0.0), lambda a, v: a + v)) / 2
    return shapes.join(ids, "id", "left_semi").select("id", "xmin", "ymax", n.cast("long").alias("n_rings"), R6(area, "area"))


@query("a8_sheet_rows", "select o_orderdate::date::varchar as day, count(*)::bigint as orders, round(sum(o_totalprice), 2) as total from orders group by all")
def a8(spark, sf_dir):
    """Orders written as workbooks, one a task, and read in blocks of rows; a sum a day of what the sheets say."""
    r, at = Region(spark, sf_dir), folder(spark, "sheets")
    formats.register(spark)
    own = r.table("orders").select(F.create_map(F.lit("Date"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Order"), F.col("o_orderkey").cast("string"), F.lit("Total"), F.col("o_totalprice").cast("string")).alias("values"))
    own.repartition(max(3, spark.sparkContext.defaultParallelism)).write.format("sheet_rows").mode("append").save(at)
    rows = spark.read.format("sheet_rows").option("blockRows", 1000).load(at)
    v = lambda k: F.element_at("values", k)
    return rows.groupBy(v("Date").alias("day")).agg(F.count("*").alias("orders"), F.round(F.sum(v("Total").cast("double")), 2).alias("total"))


_GRID = "select (c_custkey * 7919) % 48 as ix, (c_custkey * 104729) % 44 as iy, floor(sum(c_acctbal))::float::double as v from customer group by all"


@query("a15_raster_zonal_mean", "with " + P._AREAS + f", g as ({_GRID}), p as (select ix, iy, (ix + 0.5::double) * 0.125::double as x, (iy + 0.5::double) * 0.125::double as y, v from g where ix >= 8 and iy < 40), hit as (select segment, ix, iy, v from p, f group by segment, ix, iy, v, x, y having {P._INSIDE.format(x='x', y='y')}) select segment, count(*)::bigint as cells, round(avg(v), 4) as mean from hit group by segment")
def a15_raster(spark, sf_dir):
    """Mean of a raster's cells whose middles lie in each covered area; the raster is written as tiles and read by rows."""
    r, at = Region(spark, sf_dir), folder(spark, "tiles")
    formats.register(spark)
    k = F.col("c_custkey")
    cells = r.table("customer").groupBy(((k * 7919) % 48).cast("int").alias("ix"), ((k * 104729) % 44).cast("int").alias("iy")).agg(F.floor(F.sum("c_acctbal")).cast("float").alias("value"))
    cells.repartitionByRange(4, "iy").write.format("grid_tiles").option("cellSize", 0.125).mode("append").save(at)
    raster = spark.read.format("grid_tiles").option("blockRows", 4).load(at).where("ix >= 8 and iy < 40")
    hit = P.points_in_polygons(keep(raster, "raster"), P.areas(r), "x", "y", "segment")
    return hit.groupBy("segment").agg(F.count("*").alias("cells"), F.round(F.avg(F.col("value").cast("double")), 4).alias("mean"))
