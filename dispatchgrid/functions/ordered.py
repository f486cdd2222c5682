"""Running totals and neighbours in one order over all rows, without one task that sees all of them.

Rows are range-partitioned by the order and written once. What a partition hands to those after (or before) it is one row a
partition, which comes to the driver and goes back as a broadcast of so many rows; the rest is a window inside each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dispatchgrid.functions.kept import keep


class Ordered:
    """A table in an order (columns, ascending, nulls first; the last ones should tell equal rows apart)."""

    def __init__(self, df: DataFrame, *order: str):
        self.order = order
        by = [F.col(c).asc_nulls_first() for c in order]
        self.columns = df.columns
        self.rows = keep(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id().cast("long")), "ordered")
        self._up = Window.partitionBy("__part").orderBy(*by)
        self._down = Window.partitionBy("__part").orderBy(*(F.col(c).desc_nulls_last() for c in order))

    def _with(self, carried: list[tuple], fields: list[StructField]) -> DataFrame:
        small = self.rows.sparkSession.createDataFrame(carried, StructType([StructField("__part", LongType()), *fields]))
        return self.rows.join(F.broadcast(small), "__part", "left")  # a row a partition

    def running(self, **values: Column) -> DataFrame:
        """Rows with the sums of some values over all rows up to each, itself included."""
        names = list(values)
        totals = self.rows.groupBy("__part").agg(*(F.sum(v).alias(n) for n, v in values.items()))
        types = [totals.schema[n] for n in names]
        carried, before = [], [0] * len(names)
        for r in sorted(totals.collect(), key=lambda r: r["__part"]):
            carried.append((r["__part"], *(type(r[n])(b) if r[n] is not None else None for n, b in zip(names, before, strict=True))))
            before = [b + (r[n] or 0) for n, b in zip(names, before, strict=True)]
        own = self._with(carried, [StructField(f"__{n}", t.dataType) for n, t in zip(names, types, strict=True)])
        window = self._up.rowsBetween(Window.unboundedPreceding, 0)
        return own.select(*self.columns, *((F.coalesce(F.sum(v).over(window), F.lit(0)) + F.coalesce(F.col(f"__{n}"), F.lit(0))).alias(n) for n, v in values.items()))

    def next_seen(self, name: str, value: Column, itself: bool = True) -> DataFrame:
        """Rows with the next value that isn't null, in the order from each row on (or from the one after it)."""
        firsts = self.rows.where(value.isNotNull()).groupBy("__part").agg(F.min_by(value, F.struct(*self.order)).alias("v"))
        first = {r["__part"]: r["v"] for r in firsts.collect()}
        parts = sorted(r["__part"] for r in self.rows.select("__part").distinct().collect())
        carried, then = [], None
        for p in reversed(parts):
            carried.append((p, then))
            then = first.get(p, then)
        own = self._with(carried, [StructField("__then", firsts.schema["v"].dataType)])
        window = self._down.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
        return own.select(*self.columns, F.coalesce(F.last(value, ignorenulls=True).over(window), F.col("__then")).alias(name))


def chain(links: DataFrame, start: int) -> DataFrame:
    """node, rank of all nodes reached from a start by links (node, to), by pointer doubling: jumps of 1, 2, 4, ... links are
    made until none is left, and then taken from the longest on, each doubling what has been reached."""
    jump, jumps = keep(links.where("to is not null").select("node", "to"), "chain"), []
    while not jump.isEmpty():
        jumps.append(jump)
        jump = keep(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")), "chain")
    reached = links.sparkSession.createDataFrame([(start, 0)], "node long, rank long")
    for k in reversed(range(len(jumps))):
        reached = keep(reached.unionByName(reached.join(jumps[k], "node").select(F.col("to").alias("node"), (F.col("rank") + (1 << k)).alias("rank"))), "chain")
    return reached


def packed_in_order(rows: DataFrame, size: str, most: int, *order: str) -> DataFrame:
    """Rows with the number of the vehicle each goes to, in order: a new one is begun where the open one can't take the next row.

    Where a vehicle that begins with a row ends is the first running total that passes what lay before that row by more than
    the capacity; all these searches are one pass in order of totals, and the rows where vehicles really begin are the chain
    from the first row on. Sizes are whole numbers above 0."""
    at = keep(Ordered(rows, *order).running(upto=F.col(size), node=F.lit(1)), "packing")
    probe = at.select(F.greatest(F.col("upto") - F.col(size) + most, F.col("upto")).alias("v"), F.lit(1).alias("probe"), "node")
    both = at.select(F.col("upto").alias("v"), F.lit(0).alias("probe"), "node").unionByName(probe)
    links = Ordered(both, "v", "probe", "node").next_seen("to", F.when(F.col("probe") == 0, F.col("node"))).where("probe = 1").select("node", "to")
    begins = chain(links, 1).select("node", F.lit(1).alias("begin"))
    marked = at.join(begins, "node", "left").select(*rows.columns, "node", F.coalesce("begin", F.lit(0)).alias("begin"))
    return Ordered(marked, "node").running(vehicle=F.col("begin")).drop("begin", "node")
