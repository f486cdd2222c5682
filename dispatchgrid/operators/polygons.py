"""Polygons of any shape: unions traced into rings, and joins of points and lines with them.

A polygon is a row with an array of directed edges (struct ax, ay, bx, by), those of holes included; a point is inside where a
ray to the right meets an odd number of edges, lower and left sides included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.functions.kept import keep
from dispatchgrid.plans.region import Region, sql

#: The tree of cells is at most so deep; a leaf has LEAST points or fewer, or this share of all of them.
DEPTH, LEAST, LEAVES = 12, 64, 4096
EDGE = ("ax", "ay", "bx", "by")


def edge(ax, ay, bx, by) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip(EDGE, (ax, ay, bx, by), strict=True)))


# --- unions as rings -------------------------------------------------------------------------------------------------------


def boundary(edges: DataFrame, *group: str) -> DataFrame:
    """Directed edges that no other polygon of the group shares; polygons are counter-clockwise and meet edge to edge."""
    a, b = (F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("ax", "ay"), ("bx", "by")))
    sides = edges.groupBy(*group, F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.count("*").alias("n"), F.first(F.struct(*EDGE)).alias("e"))
    return sides.where("n = 1").select(*group, "e.*")


def rings(edges: DataFrame, *group: str) -> DataFrame:
    """group, ring (array of vertices in order), area (negative for holes) of boundary edges.

    Each edge is followed by the one that turns left most at its end. Rings are ordered by pointer doubling: after k rounds an
    edge knows the least edge among the 2**k from it on and how far it is, so that as many rounds are needed as the longest
    ring has binary digits. The least edge begins its ring.
    """
    e = edges.select(F.struct(*group).alias("g"), F.struct(*EDGE).alias("e"))
    out = e.select("g", F.col("e").alias("f"), F.col("e.ax").alias("x"), F.col("e.ay").alias("y"))
    come = e.select("g", "e", F.col("e.bx").alias("x"), F.col("e.by").alias("y")).join(out, ["g", "x", "y"])
    ux, uy = F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay")
    vx, vy = F.col("f.bx") - F.col("f.ax"), F.col("f.by") - F.col("f.ay")
    turn = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    at = come.groupBy("g", "e").agg(F.max_by("f", turn).alias("to"))
    at = keep(at.select("g", "e", "to", F.col("e").alias("low"), F.lit(0).cast("long").alias("far")), "rings")
    step = 1
    while True:
        then = at.select("g", F.col("e").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("far").alias("far2"))
        less = F.col("low2") < F.col("low")
        at = keep(
            at.join(then, ["g", "to"]).select(
                "g", "e", F.col("to2").alias("to"), F.when(less, F.col("low2")).otherwise(F.col("low")).alias("low"),
                F.when(less, F.col("far2") + step).otherwise(F.col("far")).alias("far"), less.alias("less"),
            ),
            "rings",
        )
        if at.where("less").isEmpty():
            break
        at, step = at.drop("less"), 2 * step
    # The edge that is farthest from the least one follows it; the least one itself is 0 away.
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("far") == 0, 0).otherwise(-F.col("far") + (1 << 40)).alias("at"), F.col("e.ax").alias("x"), F.col("e.ay").alias("y"))))
    area = F.sum(F.col("e.ax") * F.col("e.by") - F.col("e.bx") * F.col("e.ay")) / 2
    found = at.groupBy("g", "low").agg(order.alias("v"), area.alias("area"))
    return found.select("g.*", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"), "area")


def edges_of(rings_: DataFrame, *group: str) -> DataFrame:
    """One polygon a group: the edges of all its rings."""
    n = F.size("ring")
    own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: edge(F.get("ring", i)["x"], F.get("ring", i)["y"], F.get("ring", (i + 1) % n)["x"], F.get("ring", (i + 1) % n)["y"]))
    return rings_.withColumn("own", own).groupBy(*group).agg(F.flatten(F.collect_list("own")).alias("edges"))


# --- points in polygons ----------------------------------------------------------------------------------------------------


def crossings(x: Column, y: Column, edges: Column) -> Column:
    """How many edges a ray from (x, y) to the right meets."""
    meets = lambda e: ((e["ay"] <= y) != (e["by"] <= y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(edges, meets))


def _spread(v: Column) -> Column:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _code(ix: Column, iy: Column) -> Column:
    return _spread(ix.cast("long")).bitwiseOR(F.shiftleft(_spread(iy.cast("long")), 1))


class CellTree:
    """A quadtree over points, split where a cell has more than a share of them; its inner cells are at most LEAVES a level.

    Cell sides are powers of two from a whole corner, so that borders of cells are exact."""

    def __init__(self, points: DataFrame, x: str, y: str, least: int = LEAST):
        box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n")).first()
        self.empty = not box["n"] or box["x0"] is None or box["y0"] is None
        if self.empty:
            return
        self.x0, self.y0 = float(math.floor(box["x0"])), float(math.floor(box["y0"]))
        self.side = 2.0 ** math.ceil(math.log2(max(box["x1"] - self.x0, box["y1"] - self.y0) + 1e-9))
        while self.side <= max(box["x1"] - self.x0, box["y1"] - self.y0):
            self.side *= 2
        limit = max(least, box["n"] // LEAVES)
        at = points.groupBy(self.code(F.col(x), F.col(y)).alias("code")).count()
        rolled = at.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("code", 2 * (DEPTH - k)).alias("cell")) for k in range(DEPTH)))).alias("c"), "count")
        self.inner = keep(rolled.groupBy("c.level", "c.cell").agg(F.sum("count").alias("n")).where(F.col("n") > limit).select("level", "cell"), "cells")
        self.depth = (self.inner.agg(F.max("level")).first()[0] + 1) if not self.inner.isEmpty() else 0

    def code(self, x: Column, y: Column) -> Column:
        cell = lambda v, v0: F.floor((v - v0) / (self.side / (1 << DEPTH)))
        return _code(cell(x, self.x0), cell(y, self.y0))

    def _inner(self, level: int) -> DataFrame:
        # At most LEAVES rows: each has over 1 / LEAVES of all points.
        return F.broadcast(self.inner.where(F.col("level") == level).select(F.col("cell").alias(f"c{level}"), F.lit(1).alias(f"n{level}")))

    def leaf(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """Points with the leaf they lie in (level and number of the cell in one)."""
        out = points.withColumn("__code", self.code(F.col(x), F.col(y)))
        for k in range(self.depth):
            out = out.join(self._inner(k), F.shiftright("__code", 2 * (DEPTH - k)) == F.col(f"c{k}"), "left")
        level = sum((F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(self.depth)), F.lit(0))
        leaf = F.lit(0).cast("long")
        for k in range(self.depth + 1):
            leaf = F.when(F.col("__level") == k, F.lit(k).cast("long") * (1 << 40) + F.shiftright("__code", 2 * (DEPTH - k))).otherwise(leaf)
        return out.withColumn("__level", level).select(*points.columns, leaf.alias("leaf"))

    def cover(self, polygons: DataFrame, *group: str) -> DataFrame:
        """group, leaf, edges: the leaves that a polygon meets. Without edges a leaf lies inside; otherwise it has those that a
        point in it needs to be told in or out: the ones that reach its rows, in it or to the right of it."""
        eps = self.side * 1e-9
        cells = polygons.select(*group, F.lit(0).alias("l"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "edges", F.lit(False).alias("inside"))
        cells = self._kept(cells, self.side, eps, group)
        for k in range(self.depth):
            side = self.side / (1 << (k + 1))
            split = F.array(*(F.struct(F.lit(k + 1).alias("l"), (2 * F.col("i") + a).alias("i"), (2 * F.col("j") + b).alias("j")) for b in (0, 1) for a in (0, 1)))
            own = F.array(F.struct("l", "i", "j"))
            cells = cells.join(self._inner(k), (F.col("l") == k) & (_code(F.col("i"), F.col("j")) == F.col(f"c{k}")), "left")
            cells = cells.select(*group, F.explode(F.when(F.col(f"n{k}").isNotNull(), split).otherwise(own)).alias("c"), "edges", "inside").select(*group, "c.*", "edges", "inside")
            cells = self._kept(cells, side, eps, group, k + 1)
        return cells.select(*group, (F.col("l").cast("long") * (1 << 40) + _code(F.col("i"), F.col("j"))).alias("leaf"), "edges")

    def _kept(self, cells: DataFrame, side: float, eps: float, group: tuple[str, ...], level: int = 0) -> DataFrame:
        """Cells of a level that are inside or that edges pass, with the edges they need; others of the frame as they are."""
        x, y = self.x0 + F.col("i") * side, self.y0 + F.col("j") * side
        rows = lambda e: (F.greatest(e["ay"], e["by"]) >= y - eps) & (F.least(e["ay"], e["by"]) <= y + side + eps) & (F.greatest(e["ax"], e["bx"]) >= x - eps)
        new = (F.col("l") == level) & ~F.col("inside")
        cells = cells.withColumn("edges", F.when(new, F.filter("edges", rows)).otherwise(F.col("edges")))
        passes = F.exists("edges", lambda e: F.least(e["ax"], e["bx"]) <= x + side + eps)
        within = crossings(x + side / 2, y + side / 2, F.col("edges")) % 2 == 1
        cells = cells.select(*group, "l", "i", "j", "edges", F.col("inside").alias("was"), F.when(~new, "as it is").when(passes, "passed").when(within, "in").otherwise("out").alias("kind")).where("kind <> 'out'")
        none = F.filter("edges", lambda e: F.lit(False))
        return cells.select(*group, "l", "i", "j", F.when(F.col("kind") == "in", none).otherwise(F.col("edges")).alias("edges"), (F.col("was") | (F.col("kind") == "in")).alias("inside"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, *group: str, least: int = LEAST) -> DataFrame:
    """Columns of points and the group of each polygon (group columns, edges) that they lie in.

    Points and polygons meet by an equi-join on leaves of a tree of cells; a hot leaf is split by adaptive execution. Points
    of leaves inside a polygon need no test."""
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    tree = CellTree(placed, x, y, least)
    if tree.empty:
        return points.limit(0).crossJoin(polygons.select(*group).limit(0))
    hits = tree.leaf(placed, x, y).join(tree.cover(polygons, *group), "leaf")
    return hits.where((F.size("edges") == 0) | (crossings(F.col(x), F.col(y), F.col("edges")) % 2 == 1)).select(*points.columns, *group)


# --- lines and polygons ----------------------------------------------------------------------------------------------------


def cells_of(ax: Column, ay: Column, bx: Column, by: Column, side: float) -> Column:
    """Every square cell (struct cx, cy) that a segment runs through or along."""
    eps = 1e-9 * side
    lo, hi = F.least(ax, bx), F.greatest(ax, bx)
    first, last = F.floor((lo - eps) / side), F.floor((hi + eps) / side)

    def column(i):
        x = lambda edge_: F.greatest(lo, F.least(hi, edge_))
        height = lambda edge_: F.when(ax == bx, ay).otherwise(ay + (x(edge_) - ax) * (by - ay) / (bx - ax))
        a = F.when(ax == bx, F.least(ay, by)).otherwise(F.least(height(i * side), height((i + 1) * side)))
        b = F.when(ax == bx, F.greatest(ay, by)).otherwise(F.greatest(height(i * side), height((i + 1) * side)))
        return F.transform(F.sequence(F.floor((a - eps) / side), F.floor((b + eps) / side)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))

    return F.flatten(F.transform(F.sequence(first, last), column))


def segments_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments share a point, ends and overlaps included."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    o1, o2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    o3, o4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    boxes = (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    return boxes & (o1 * o2 <= 0) & (o3 * o4 <= 0)


def lines_in_polygons(lines: DataFrame, polygons: DataFrame, key: str, *group: str) -> DataFrame:
    """key and group of each segment (ax, ay, bx, by) and polygon that share a point.

    Segments and edges are dealt to the square cells they run through, of about one edge each, and meet by an equi-join on
    cells; segments wholly inside a polygon are found by their first end."""
    edges = keep(polygons.select(*group, F.explode("edges").alias("f")), "edges")
    box = edges.agg(F.min(F.least("f.ax", "f.bx")).alias("x0"), F.max(F.greatest("f.ax", "f.bx")).alias("x1"), F.min(F.least("f.ay", "f.by")).alias("y0"), F.max(F.greatest("f.ay", "f.by")).alias("y1"), F.count("*").alias("n")).first()
    inside = points_in_polygons(lines.select(key, "ax", "ay"), polygons, "ax", "ay", *group).select(key, *group)
    if not box["n"]:
        return inside
    side = max(((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) / box["n"]) ** 0.5, (box["x1"] - box["x0"] + box["y1"] - box["y0"]) / 1e4, 1e-9)
    dealt = edges.select("*", F.explode(cells_of(*(F.col(f"f.{c}") for c in EDGE), side)).alias("c"))
    ours = lines.where((F.greatest("ax", "bx") >= box["x0"]) & (F.least("ax", "bx") <= box["x1"]) & (F.greatest("ay", "by") >= box["y0"]) & (F.least("ay", "by") <= box["y1"]))
    ours = ours.select(key, *EDGE, F.explode(cells_of(*(F.col(c) for c in EDGE), side)).alias("c"))
    met = ours.join(dealt, "c").where(segments_meet(tuple(F.col(c) for c in EDGE), tuple(F.col(f"f.{c}") for c in EDGE)))
    return met.select(key, *group).unionByName(inside).distinct()


# --- queries over the given tables -----------------------------------------------------------------------------------------


def square_edges(x: Column, y: Column) -> Column:
    """The sides of a unit square, counter-clockwise."""
    return F.array(edge(x, y, x + 1, y), edge(x + 1, y, x + 1, y + 1), edge(x + 1, y + 1, x, y + 1), edge(x, y + 1, x, y))


def covered_edges(r: Region) -> DataFrame:
    """Outlines, by market segment, of the cells of a 20 x 20 grid that hold as many customers as the average cell or more."""
    c = r.table("customer").select(F.col("c_mktsegment").alias("segment"), ((F.col("c_custkey") * 7919) % 400).alias("cell"))
    n = c.groupBy("segment").agg((F.count("*") / 400.0).alias("mean"))
    cells = c.groupBy("segment", "cell").agg(F.count("*").alias("n")).join(n, "segment").where("n >= mean").select("segment", "cell")
    sides = cells.select("segment", F.explode(square_edges(F.col("cell") % 20, F.floor(F.col("cell") / 20))).alias("e")).select("segment", "e.*")
    return keep(boundary(sides, "segment"), "covered")


def areas(r: Region) -> DataFrame:
    """Covered areas by market segment as polygons in km: many rings, holes and concave parts, no side along an axis."""
    place = lambda p: F.struct((0.25 * p["x"] + 0.06 * p["y"]).alias("x"), (0.25 * p["y"] - 0.04 * p["x"]).alias("y"))
    traced = rings(covered_edges(r), "segment").select("segment", F.transform("ring", place).alias("ring"))
    return keep(edges_of(traced, "segment"), "areas")


def riders_at(r: Region) -> DataFrame:
    """A place of each customer, in km."""
    k = F.col("c_custkey")
    return r.table("customer").select("c_custkey", ((k * 104729) % 6007 / 1000.0).alias("x_km"), ((k * 1299709) % 5501 / 1000.0).alias("y_km"))


def legs_of(r: Region) -> DataFrame:
    """A trip of each order from its customer's place to its clerk's."""
    k, h = F.col("o_custkey"), F.col("o_orderkey")
    ax, ay = (k * 104729) % 6007 / 1000.0, (k * 1299709) % 5501 / 1000.0
    return r.table("orders").select("o_orderkey", ax.alias("ax"), ay.alias("ay"), (ax + (h * 31) % 101 / 500.0 - 0.1).alias("bx"), (ay + (h * 37) % 103 / 500.0 - 0.1).alias("by"))


_COVERED = """cell as (select c_mktsegment as segment, (c_custkey * 7919) % 400 as cell, count(*) as n from customer group by all),
cov as (select segment, cell % 20 as x, cell // 20 as y from cell join (select c_mktsegment as segment, count(*) / 400.0 as mean from customer group by 1) using (segment) where n >= mean),
{rings}"""
_TRACE = """side as (select {g} as g, x + s.ax as ax, y + s.ay as ay, x + s.bx as bx, y + s.b_y as b_y from {t}, (values (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) s(ax, ay, bx, b_y)),
e as (select a.* from side a anti join side b on a.g = b.g and a.ax = b.bx and a.ay = b.b_y and a.bx = b.ax and a.b_y = b.ay),
nx as (select a.g, a.ax, a.ay, a.bx, a.b_y, arg_max({{'x': b.ax, 'y': b.ay, 'x2': b.bx, 'y2': b.b_y}}, atan2((a.bx - a.ax) * (b.b_y - b.ay) - (a.b_y - a.ay) * (b.bx - b.ax), (a.bx - a.ax) * (b.bx - b.ax) + (a.b_y - a.ay) * (b.b_y - b.ay))) as t from e a join e b on a.g = b.g and a.bx = b.ax and a.b_y = b.ay group by all),
w as (select g, ax, ay, bx, b_y, 0 as i, ax as cx, ay as cy, bx as dx, b_y as dy from e union all
select w.g, w.ax, w.ay, w.bx, w.b_y, i + 1, nx.t.x, nx.t.y, nx.t.x2, nx.t.y2 from w join nx on nx.g = w.g and nx.ax = cx and nx.ay = cy and nx.bx = dx and nx.b_y = dy where not (nx.t.x = w.ax and nx.t.y = w.ay and nx.t.x2 = w.bx and nx.t.y2 = w.b_y) and (nx.t.x, nx.t.y, nx.t.x2, nx.t.y2) > (w.ax, w.ay, w.bx, w.b_y)),
done as (select w.g, w.ax, w.ay, w.bx, w.b_y from w join nx using (g) where nx.ax = cx and nx.ay = cy and nx.bx = dx and nx.b_y = dy and nx.t.x = w.ax and nx.t.y = w.ay and nx.t.x2 = w.bx and nx.t.y2 = w.b_y)"""
_RINGS = "select g as {name}, string_agg(cx::int || ' ' || cy::int, ',' order by i) as path, sum(cx * dy - dx * cy)::double / 2 as area, count(*)::bigint as n_vertices from w join done using (g, ax, ay, bx, b_y) group by g, ax, ay, bx, b_y"


def _as_rows(found: DataFrame, name: str) -> DataFrame:
    path = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["x"].cast("int"), p["y"].cast("int"))), ",")
    return found.select(name, path.alias("path"), "area", F.size("ring").cast("long").alias("n_vertices"))


@query("g8_district_rings", sql("with " + _TRACE.format(g="district", t="(select district, x_km::int as x, y_km::int as y from blocks)") + " " + _RINGS.format(name="district"), "blocks", recursive=True))
def g8_district_rings(spark, sf_dir):
    """The outline of each district as rings of vertices in order; holes have a negative area."""
    sides = Region(spark, sf_dir).blocks().select("district", F.explode(square_edges(F.col("x_km"), F.col("y_km"))).alias("e")).select("district", "e.*")
    return _as_rows(rings(boundary(sides, "district"), "district"), "district")


@query("g8_covered_rings", "with recursive " + _COVERED.format(rings=_TRACE.format(g="segment", t="cov")) + " " + _RINGS.format(name="segment"))
def g8_covered_rings(spark, sf_dir):
    return _as_rows(rings(covered_edges(Region(spark, sf_dir)), "segment"), "segment")


_AREAS = _COVERED.format(rings="""side as (select segment, x + s.ax as ax, y + s.ay as ay, x + s.bx as bx, y + s.b_y as b_y from cov, (values (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) s(ax, ay, bx, b_y)),
f as (select a.segment, 0.25::double * a.ax + 0.06::double * a.ay as ax, 0.25::double * a.ay - 0.04::double * a.ax as ay, 0.25::double * a.bx + 0.06::double * a.b_y as bx, 0.25::double * a.b_y - 0.04::double * a.bx as b_y from side a anti join side b on a.segment = b.segment and a.ax = b.bx and a.ay = b.b_y and a.bx = b.ax and a.b_y = b.ay)""")
_INSIDE = "count(*) filter (where (f.ay <= {y}) <> (f.b_y <= {y}) and {x} < (f.bx - f.ax) * ({y} - f.ay) / (f.b_y - f.ay) + f.ax) % 2 = 1"
_PLACES = "select c_custkey, (c_custkey * 104729) % 6007 / 1000.0::double as x, (c_custkey * 1299709) % 5501 / 1000.0::double as y from customer"
_LEGS = "select o_orderkey, (o_custkey * 104729) % 6007 / 1000.0::double as ax, (o_custkey * 1299709) % 5501 / 1000.0::double as ay, (o_custkey * 104729) % 6007 / 1000.0::double + (o_orderkey * 31) % 101 / 500.0::double - 0.1::double as bx, (o_custkey * 1299709) % 5501 / 1000.0::double + (o_orderkey * 37) % 103 / 500.0::double - 0.1::double as b_y from orders"
_SIDE = "sign(({1} - {0}) * ({5} - {3}) - ({4} - {3}) * ({2} - {0}))"
_MEET = f"""least(l.ax, l.bx) <= greatest(f.ax, f.bx) and least(f.ax, f.bx) <= greatest(l.ax, l.bx) and least(l.ay, l.b_y) <= greatest(f.ay, f.b_y) and least(f.ay, f.b_y) <= greatest(l.ay, l.b_y)
and {_SIDE.format('l.ax', 'l.bx', 'f.ax', 'l.ay', 'l.b_y', 'f.ay')} * {_SIDE.format('l.ax', 'l.bx', 'f.bx', 'l.ay', 'l.b_y', 'f.b_y')} <= 0
and {_SIDE.format('f.ax', 'f.bx', 'l.ax', 'f.ay', 'f.b_y', 'l.ay')} * {_SIDE.format('f.ax', 'f.bx', 'l.bx', 'f.ay', 'f.b_y', 'l.b_y')} <= 0"""

@query("c7_points_in_areas", f"with {_AREAS}, p as ({_PLACES}) select c_custkey, segment from p, f group by c_custkey, segment, x, y having {_INSIDE.format(x='x', y='y')}")
def c7_points_in_areas(spark, sf_dir):
    """Customers' places in areas with holes and concave parts, which overlap."""
    r = Region(spark, sf_dir)
    return points_in_polygons(riders_at(r), areas(r), "x_km", "y_km", "segment").select("c_custkey", "segment")


@query("c7_points_left", f"with {_AREAS}, p as ({_PLACES}), hit as (select c_custkey, count(*) as n from (select c_custkey, segment from p, f group by c_custkey, segment, x, y having {_INSIDE.format(x='x', y='y')}) group by 1) select c_custkey, coalesce(n, 0)::bigint as n_areas from customer left join hit using (c_custkey)")
def c7_points_left(spark, sf_dir):
    """The left form: every customer, with how many areas they are in."""
    r = Region(spark, sf_dir)
    n = points_in_polygons(riders_at(r), areas(r), "x_km", "y_km", "segment").groupBy("c_custkey").agg(F.count("*").alias("n"))
    return r.table("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_areas"))


@query("c8_trips_in_areas", f"with {_AREAS}, l as ({_LEGS}), hit as (select o_orderkey, segment from l, f where {_MEET} union select o_orderkey, segment from l, f group by o_orderkey, segment, l.ax, l.ay having {_INSIDE.format(x='l.ax', y='l.ay')}) select o_orderkey, segment from hit")
def c8_trips_in_areas(spark, sf_dir):
    """Every area that an order's trip meets."""
    r = Region(spark, sf_dir)
    return lines_in_polygons(legs_of(r), areas(r), "o_orderkey", "segment")


_ROUTE = "g as (select stop, x_km as ax, y_km as ay, lead(x_km) over (partition by route order by seq) as bx, lead(y_km) over (partition by route order by seq) as b_y from stops), l as (select stop as o_orderkey, ax, ay, ax + (bx - ax) / 20 as bx, ay + (b_y - ay) / 20 as b_y from g where bx is not null and stop % 7 = 0)"


@query("c9_areas_near_lines", sql(f"""with {_AREAS}, {_ROUTE},
sq as (select segment, x::int as x, y::int as y, 0.25::double * (x + a) + 0.06::double * (y + b) as ax, 0.25::double * (y + b) - 0.04::double * (x + a) as ay, 0.25::double * (x + c) + 0.06::double * (y + d) as bx, 0.25::double * (y + d) - 0.04::double * (x + c) as b_y from cov, (values (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) s(a, b, c, d)),
met as (select distinct segment, x, y from sq f, l where {_MEET} union select distinct segment, x, y from (select segment, x, y, l.o_orderkey from sq f, l group by segment, x, y, l.o_orderkey, l.ax, l.ay having {_INSIDE.format(x='l.ax', y='l.ay')}))
select distinct sq.segment, sq.x, sq.y, met.x is not null as near_line from sq left join met using (segment, x, y)""", "stops"))
def c9_areas_near_lines(spark, sf_dir):
    """Which cells of the covered areas a piece of line runs through, as a flag."""
    from pyspark.sql import Window

    r = Region(spark, sf_dir)
    w = Window.partitionBy("route").orderBy("seq")
    s = r.stops().select("stop", F.col("x_km").alias("ax"), F.col("y_km").alias("ay"), F.lead("x_km").over(w).alias("nx"), F.lead("y_km").over(w).alias("ny")).where("nx is not null and stop % 7 = 0")
    pieces = s.select("stop", "ax", "ay", (F.col("ax") + (F.col("nx") - F.col("ax")) / 20).alias("bx"), (F.col("ay") + (F.col("ny") - F.col("ay")) / 20).alias("by"))
    return cells_near(r, pieces)


def cells_near(r: Region, pieces: DataFrame) -> DataFrame:
    c = r.table("customer").select(F.col("c_mktsegment").alias("segment"), ((F.col("c_custkey") * 7919) % 400).alias("cell"))
    mean = c.groupBy("segment").agg((F.count("*") / 400.0).alias("mean"))
    cells = c.groupBy("segment", "cell").agg(F.count("*").alias("n")).join(mean, "segment").where("n >= mean").select("segment", (F.col("cell") % 20).cast("int").alias("x"), F.floor(F.col("cell") / 20).cast("int").alias("y"))
    at = lambda dx, dy: (0.25 * (F.col("x") + dx) + 0.06 * (F.col("y") + dy), 0.25 * (F.col("y") + dy) - 0.04 * (F.col("x") + dx))
    corners = [at(0, 0), at(1, 0), at(1, 1), at(0, 1)]
    cells = keep(cells.withColumn("edges", F.array(*(edge(*corners[k], *corners[(k + 1) % 4]) for k in range(4)))), "cells")
    near = lines_in_polygons(pieces, cells, "stop", "segment", "x", "y").select("segment", "x", "y").distinct().withColumn("near_line", F.lit(True))
    return cells.select("segment", "x", "y").join(near, ["segment", "x", "y"], "left").select("segment", "x", "y", F.coalesce("near_line", F.lit(False)).alias("near_line"))


@query("b6_clip_rings", "with recursive " + _COVERED.format(rings=_TRACE.format(g="segment", t="cov")) + ", r as (select g as segment, min(cx) as x0, max(cx) as x1, min(cy) as y0, max(cy) as y1 from w join done using (g, ax, ay, bx, b_y) group by g, ax, ay, bx, b_y), m as (select avg(x) as mx, avg(y) as m_y from cov) select segment, count(*)::bigint as n_rings from r, m where x0 <= mx + 3 and x1 >= mx - 3 and y0 <= m_y + 3 and y1 >= m_y - 3 group by segment")
def b6_clip_rings(spark, sf_dir):
    """Rings whose box overlaps a window about the middle of all covered cells."""
    r = Region(spark, sf_dir)
    c = r.table("customer").select(F.col("c_mktsegment").alias("segment"), ((F.col("c_custkey") * 7919) % 400).alias("cell"))
    mean = c.groupBy("segment").agg((F.count("*") / 400.0).alias("mean"))
    m = c.groupBy("segment", "cell").agg(F.count("*").alias("n")).join(mean, "segment").where("n >= mean").agg(F.avg(F.col("cell") % 20).alias("x"), F.avg(F.floor(F.col("cell") / 20)).alias("y")).first()
    if m["x"] is None:
        return spark.createDataFrame([], "segment string, n_rings long")
    low, high = lambda c_: F.array_min(F.transform("ring", lambda p: p[c_])), lambda c_: F.array_max(F.transform("ring", lambda p: p[c_]))
    own = rings(covered_edges(r), "segment").where((low("x") <= m["x"] + 3) & (high("x") >= m["x"] - 3) & (low("y") <= m["y"] + 3) & (high("y") >= m["y"] - 3))
    return own.groupBy("segment").agg(F.count("*").alias("n_rings"))
