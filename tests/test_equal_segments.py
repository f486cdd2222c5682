"""Equal segments and sites at one place are met once by each point, and the smallest rank is the pick."""

from pyspark.sql import functions as F

from dispatchgrid.operators import nearest as N


def test_copies_meet_no_point(spark, monkeypatch):
    met = []
    search = N._search
    monkeypatch.setattr(N, "_search", lambda p, s, *a: met.append(s.count()) or search(p, s, *a))
    monkeypatch.setattr(N, "BROADCAST_ROWS", 5)
    points = spark.range(40).select("id", (F.col("id") * 7 % 10 / 2.0).alias("x_km"), (F.col("id") * 3 % 10 / 2.0).alias("y_km"))
    lines = spark.range(600).select((F.col("id") + 5).alias("k"), (F.col("id") % 6 * 1.0).alias("ax"), F.lit(1.0).alias("ay"), (F.col("id") % 6 + 0.5).alias("bx"), F.lit(2.0).alias("by"))
    picks = [r["pick"] for r in N.nearest_segment(points, lines, "id", "k").collect()]
    assert len(picks) == 40 and set(picks) <= set(range(5, 11))
    picks = [r["pick"] for r in N.nearest(points, lines.select("k", F.col("ax").alias("x_km"), F.col("ay").alias("y_km")), "id", "k").collect()]
    assert len(picks) == 40 and set(picks) <= set(range(5, 11)) and met == [6, 6]


def test_points_outside_look_from_the_border(spark, monkeypatch):
    """Points far out found their pick only in cells as wide as the map, where each met most segments; lists are cut where long."""
    monkeypatch.setattr(N, "BROADCAST_ROWS", 5)
    points = spark.range(300).select("id", (F.col("id") * 7919 % 101 / 5.0 - 6).alias("x_km"), (F.col("id") * 104729 % 97 / 5.0 - 5).alias("y_km"))
    lines = spark.range(1500).select("id", (F.col("id") * 31 % 97 / 10.0).alias("ax"), (F.col("id") * 57 % 89 / 10.0).alias("ay")).select("id", "ax", "ay", (F.col("ax") + F.col("id") % 5 / 10.0).alias("bx"), (F.col("ay") + F.col("id") % 3 / 10.0).alias("by"))
    sites = lines.select("id", F.col("ax").alias("x_km"), F.col("ay").alias("y_km"))
    edge = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    all_ = points.withColumnRenamed("id", "p").crossJoin(lines)
    want = []
    for km in (N.segment_distance(F.col("x_km"), F.col("y_km"), *edge), N.distance(F.col("x_km"), F.col("y_km"), edge[0], edge[1])):
        near = all_.select("p", F.struct(F.round(km, 9).alias("km"), "id").alias("b")).groupBy("p").agg(F.min("b").alias("b"))
        want.append({r["p"]: (r["b"]["id"], r["b"]["km"]) for r in near.collect()})
    widths, cells = [], N.cells_of
    monkeypatch.setattr(N, "cells_of", lambda *a: widths.append(a[-1]) or cells(*a))
    for rows, most in ((N.LISTED_ROWS, N.LISTED_BROADCAST), (7, 50)):
        monkeypatch.setattr(N, "LISTED_ROWS", rows)
        monkeypatch.setattr(N, "LISTED_BROADCAST", most)
        got = {r["id"]: (r["pick"], round(r["km"], 9)) for r in N.nearest_segment(points, lines, "id", "id").collect()}
        assert got == want[0]
        got = {r["id"]: (r["pick"], round(r["km"], 9)) for r in N.nearest(points, sites, "id", "id").collect()}
        assert got == want[1]
    assert max(widths) < 4
