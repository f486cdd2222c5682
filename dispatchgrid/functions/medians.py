"""Exact medians of large groups without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, LEFT, MOST_GROUPS = 1024, 50_000, 10_000


def exact_medians(df: DataFrame, value: Column, by: Column | None = None) -> DataFrame:
    """key, median of the groups of `by` (one group, key 0, without it); null values are left out.

    Values are counted in bins between a group's bounds, and the bounds close in on the bins that hold the middle ranks,
    until no more than LEFT values lie between them: each round moves a row a bin and group. Groups of up to LEFT values are
    taken as they are. Bounds of the groups pass through the driver, up to MOST_GROUPS of them (checked).
    """
    d = df.select((F.lit(0) if by is None else by).alias("key"), value.cast("double").alias("v")).where("v is not null")
    kind = d.schema["key"].dataType.simpleString()
    bounds = d.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(0).cast("bigint").alias("below"), F.count("*").alias("held"))
    schema = f"key {kind}, n bigint, lo double, hi double, below bigint, held bigint"
    rows = bounds.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups; they are small enough for the built-in median")
    while any(r["held"] > LEFT and r["lo"] < r["hi"] for r in rows):
        now = d.sparkSession.createDataFrame(rows, schema)
        inside = d.join(F.broadcast(now), "key").where("v between lo and hi")
        width = (F.col("hi") - F.col("lo")) / BINS
        place = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))))).otherwise(0)
        c = inside.groupBy("key", "n", "below", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy("key").orderBy("bin"))
        c = c.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("c"))
        middle = lambda k: (F.col("start") <= k) & (k < F.col("upto"))
        hit = c.where(middle(F.floor((F.col("n") - 1) / 2)) | middle(F.floor(F.col("n") / 2)))
        rows = hit.groupBy("key").agg(F.first("n").alias("n"), F.min("a").alias("lo"), F.max("b").alias("hi"), F.min("start").alias("below"), F.sum("c").alias("held")).collect()
    last = d.join(F.broadcast(d.sparkSession.createDataFrame(rows, schema)), "key").where("v between lo and hi")
    # Equal values beyond LEFT need no order among themselves.
    c = last.groupBy("key", "n", "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("key").orderBy("v"))
    c = c.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("c"))
    at = lambda k: F.max(F.when((F.col("start") <= k) & (k < F.col("upto")), F.col("v")))
    return c.groupBy("key").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))
