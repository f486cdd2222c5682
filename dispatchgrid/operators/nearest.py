"""Nearest neighbours of points, among points or segments, by expanding grid cells, without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchgrid.functions.exprs import distance, segment_distance
from dispatchgrid.functions.kept import keep
from dispatchgrid.operators.polygons import EDGE, cells_of

BROADCAST_ROWS = 500
#: Sites in a list, and in all lists that are broadcast, at most.
LISTED_ROWS, LISTED_BROADCAST = 20_000, 500_000


def nearest(points: DataFrame, sites: DataFrame, key: str, rank: str, x: str = "x_km", y: str = "y_km") -> DataFrame:
    """key, pick (the site's rank value), km: each point's nearest site, ties to the smallest rank.

    Sites up to BROADCAST_ROWS (counted first) are broadcast and reduced in place by min_by; more are searched by cells."""
    p = points.select(key, F.col(x).alias("px"), F.col(y).alias("py"))
    s = sites.groupBy(F.col(x).alias("sx"), F.col(y).alias("sy")).agg(F.min(rank).alias("rank"))  # of sites at one place the smallest rank is the pick
    km = distance(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"))
    if s.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return p.crossJoin(F.broadcast(s)).groupBy(key).agg(_best(km)).select(key, F.col("b.rank").alias("pick"), F.col("b.km").alias("km"))
    box = s.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"), F.count("*").alias("n")).first()
    width = (((box["x1"] - box["x0"]) * (box["y1"] - box["y0"])) / box["n"]) ** 0.5
    cells = lambda w: F.array(F.struct(F.floor(F.col("sx") / w).alias("cx"), F.floor(F.col("sy") / w).alias("cy")))
    return _search(p, s, key, lambda g: distance(F.col("px"), F.col("py"), g["sx"], g["sy"]), cells, width, box)


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, rank: str, x: str = "x_km", y: str = "y_km") -> DataFrame:
    """key, pick, km: each point's nearest segment (ax, ay, bx, by), ties to the smallest rank. A segment is dealt to every cell
    that it runs through, so what is not among the cells around a point is no nearer than their edge."""
    p = points.select(key, F.col(x).alias("px"), F.col(y).alias("py"))
    # Of equal segments the smallest rank is the pick, whatever the point.
    s = keep(segments.groupBy(*EDGE).agg(F.min(rank).alias("rank")), "segments")
    km = lambda g: segment_distance(F.col("px"), F.col("py"), *(g[c] for c in EDGE))
    length = distance(*(F.col(c) for c in EDGE))
    box = s.agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"), F.count("*").alias("n"), F.avg(length).alias("length")).first()
    if not box["n"]:
        return p.limit(0).select(key, F.lit(None).cast(s.schema["rank"].dataType).alias("pick"), F.lit(None).cast("double").alias("km"))
    # Wide enough for a few cells a segment.
    width = max((((box["x1"] - box["x0"]) * (box["y1"] - box["y0"])) / box["n"]) ** 0.5, box["length"] / 8)
    return _search(p, s, key, km, lambda w: cells_of(*(F.col(c) for c in EDGE), w), width, box)


def _best(km: Column) -> Column:
    return F.min_by(F.struct("rank", km.alias("km")), F.struct(F.round(km, 9), "rank")).alias("b")


def _search(p: DataFrame, s: DataFrame, key: str, km, cells, width: float, box) -> DataFrame:
    """Each cell lists the sites of its own and the eight around it, and a point takes the least of its cell's list within its row;
    km: the distance to a site. Points outside the box of all sites look from the nearest place in it: what isn't listed there is
    farther from that place than the cells' width, and from the point farther than both together (by Pythagoras, as the box is
    convex). Points that aren't certain look again into wider cells. A round writes its points once, so none plans those before."""
    width, span = max(width, 1e-9), max(box["x1"] - box["x0"], box["y1"] - box["y0"]) * 2 + width
    inside = lambda c, a, b: F.greatest(F.lit(box[a]), F.least(F.lit(box[b]), F.col(c)))
    qx, qy = inside("px", "x0", "x1"), inside("py", "y0", "y1")
    out, left = None, p.distinct()
    while True:
        last = width > span
        around = lambda c: F.array(*(F.struct((c["cx"] + i).alias("cx"), (c["cy"] + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        listed = keep(s.select(F.struct(*s.columns).alias("site"), F.explode(F.array_distinct(F.flatten(F.transform(cells(width), around)))).alias("c")), "listed")
        n = listed.groupBy("c").agg(F.count("*").alias("n"))
        size = n.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
        slot = F.lit(0)
        if split := size["most"] > LISTED_ROWS:  # lists of a bounded length
            listed = listed.join(F.broadcast(n.where(F.col("n") > LISTED_ROWS)), "c", "left")
            slot = F.coalesce(F.pmod(F.xxhash64("site"), F.ceil(F.col("n") / LISTED_ROWS)), F.lit(0))
        lists = listed.groupBy("c", slot.alias("slot")).agg(F.collect_list("site").alias("sites")).drop("slot")
        lists = F.broadcast(lists) if size["all"] <= LISTED_BROADCAST else lists
        look = left.withColumn("c", F.struct(F.floor(qx / width).alias("cx"), F.floor(qy / width).alias("cy"))).join(lists, "c", "left")
        far = F.transform("sites", lambda g: F.struct(km(g).alias("km"), g["rank"].alias("rank")))
        best = F.array_min(F.transform(far, lambda g: F.struct(F.round(g["km"], 9).alias("by"), g["rank"].alias("rank"), g["km"].alias("km"))))
        look = look.select(key, "px", "py", best.alias("b"))
        if split:
            look = look.groupBy(key, "px", "py").agg(F.min("b").alias("b"))
        sure = F.lit(last) | F.coalesce(F.col("b.km") <= F.hypot(distance(F.col("px"), F.col("py"), qx, qy), F.lit(width)), F.lit(False))
        look = keep(look.select(key, "px", "py", F.col("b.rank").alias("pick"), F.col("b.km").alias("km"), sure.alias("sure")), "nearest")
        found = look.where("sure").select(key, "pick", "km")
        out = found if out is None else out.unionByName(found)
        left = look.where("not sure").select(key, "px", "py")
        width *= 2
        if last or left.isEmpty():
            return out
