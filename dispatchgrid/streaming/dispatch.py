"""Dispatch batching as a stream: beyond the batch operators, the same wait-to-departure rule over live arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dispatch_batches(arrivals: DataFrame, interval: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, riders, mean_wait_h per departure window of a stream with a timestamp column ts.

    The watermark bounds the state: windows close once no rider of theirs can still come, and later ones are dropped.
    """
    t = arrivals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # A window's mean wait is its end less the mean arrival, so the state per window is a count and a sum.
    out = t.groupBy(F.window("ts", interval).alias("w")).agg(F.count("*").alias("riders"), F.avg(F.unix_micros("ts") / 3.6e9).alias("mean_h"))
    return out.select(F.col("w.start").alias("start"), "riders", F.round(F.unix_micros("w.end") / 3.6e9 - F.col("mean_h"), 6).alias("mean_wait_h"))
