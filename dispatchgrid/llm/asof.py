"""As-of join with a tolerance, by a two-level blocked predecessor search.

Times of a key fall into buckets of BUCKET_US microseconds, and buckets into spans a little longer than the tolerance. Right rows
are first aggregated to one a key and time (the preferred row, and how many there are), left rows to distinct times, so a hot
instant of a hot key is one row on either side. Then
  1. in each bucket, in order of time, every left time takes the last right row before it (a window over key and bucket);
  2. the latest right row of each bucket gets a prefix maximum over the buckets of its span, with the latest of the span before
     in front, so that each bucket has a carried predecessor;
  3. left times that found nothing in their own bucket take the carried one of it by an equi-join;
  4. left rows take what their key and time found by an equi-join, whose large partitions Spark can split.
Groups are bounded by the clock, whatever the number of rows: a bucket has at most BUCKET_US distinct times a side, a span at most
(tolerance / BUCKET_US) + 2 buckets. Nothing is broadcast or sent to the driver by this module.

Nulls: a left row with a null key or time is returned unmatched, and goes past the joins; a right row with one is left out.
A null in the preference loses against any value. Ties: right rows with equal time and preference are chosen by the least
payload. Repeated right rows count each. Repeated left rows: each row is returned. Empty tables: no rows, or all unmatched.
Other columns of the left side are carried, those of the right side ignored; names may be the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Over 67 seconds: 2**26 microseconds.
BUCKET_US = 1 << 26
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column; without a zone it is taken as it is written."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"unix_date(cast(`{name}` as date)) * {DAY_US} + (hour(`{name}`) * 3600 + minute(`{name}`) * 60) * 1000000L + cast(extract(second from `{name}`) * 1000000 as bigint)")
    return F.unix_micros(F.col(name).cast("timestamp"))


def _floor(name: str, by: int) -> Column:
    return F.expr(f"{name} div {by} - if({name} % {by} < 0, 1, 0)")


def tolerant_asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tolerance_us: int, prefer: list[Column], payload: list[str]) -> DataFrame:
    """Left rows with a struct `match` of right_time, n_tied and the payload columns, null where nothing lies within tolerance.

    Times are microseconds. Of right rows of one key and time, the one with the least `prefer` wins, nulls last."""
    parts = [p for i, c in enumerate(prefer) for p in (c.isNull().alias(f"__n{i}"), c.alias(f"__p{i}"))]
    rows = right.select(F.col(key).alias("k"), F.col(right_time).alias("t"), F.struct(*parts, F.struct(*[F.col(c) for c in payload]).alias("row")).alias("best"))
    known = rows.where("k is not null and t is not null").groupBy("k", "t").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    match = F.struct(F.col("t").alias(right_time), F.col("n").alias("n_tied"), *[F.col(f"best.row.{c}").alias(c) for c in payload])
    known = known.select("k", "t", F.lit(0).alias("side"), match.alias("match"))
    asked = left.select(F.col(key).alias("k"), F.col(left_time).alias("t")).where("k is not null and t is not null").distinct().select("k", "t", F.lit(1).alias("side"), F.lit(None).cast(known.schema["match"].dataType).alias("match"))
    scratch = Scratch(left.sparkSession, "asof")
    both = scratch.keep(known.unionByName(asked).withColumn("bucket", _floor("t", BUCKET_US)), "both")

    own = Window.partitionBy("k", "bucket").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    searched = both.withColumn("match", F.last("match", ignorenulls=True).over(own)).where("side = 1").select("k", "t", "bucket", "match")

    buckets = tolerance_us // BUCKET_US + 2
    latest = both.groupBy("k", "bucket").agg(F.max("match").alias("match")).withColumn("span", _floor("bucket", buckets))
    latest = scratch.keep(latest, "latest")
    before = Window.partitionBy("k", "span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = latest.groupBy("k", "span").agg(F.max("match").alias("earlier")).withColumn("span", F.col("span") + 1)
    carried = latest.withColumn("carried", F.last("match", ignorenulls=True).over(before)).join(last, ["k", "span"], "left")
    carried = carried.select("k", "bucket", F.coalesce("carried", "earlier").alias("carried")).where("carried is not null")

    found = searched.where("match is not null").select("k", "t", "match").unionByName(
        searched.where("match is null").join(carried, ["k", "bucket"]).select("k", "t", F.col("carried").alias("match"))
    )
    found = found.where(F.col("t") - F.col(f"match.{right_time}") <= tolerance_us).select(F.col("k").alias("__k"), F.col("t").alias("__t"), "match")
    placed = F.col(key).isNotNull() & F.col(left_time).isNotNull()
    hit = left.where(placed).join(found, (F.col(key) == F.col("__k")) & (F.col(left_time) == F.col("__t")), "left").select(*left.columns, "match")
    return hit.unionByName(left.where(~placed).withColumn("match", F.lit(None).cast(hit.schema["match"].dataType)))


def floored(time: Column, h: Column) -> Column:
    """Odd hashes: times are only known to the day."""
    return F.when(h % 2 == 1, time - F.pmod(time, F.lit(DAY_US))).otherwise(time)


def clicks_once(clicks: DataFrame) -> DataFrame:
    """click_id, client_id, ts_us of each click once. Of copies that differ, the latest stays; rows without an id are told apart
    by client and time."""
    h = F.crc32(F.col("click_id").cast("string"))
    rows = clicks.select(F.col("click_id").cast("long"), F.col("client_id").cast("long"), micros(clicks, "ts").alias("t")).select("*", F.when(F.col("click_id").isNull(), F.struct("client_id", "t")).alias("apart"))
    once = rows.groupBy("click_id", "apart").agg(F.max(F.struct("t", "client_id")).alias("own")).select("click_id", "own.client_id", "own.t")
    return once.select("click_id", "client_id", floored(F.col("t"), h).alias("ts_us"))


def orders_of(sales: DataFrame) -> DataFrame:
    """client_id, at_us, priority, sale_id, total_cents of each sale, and of the second order that most sales have."""
    h = F.crc32(F.col("sale_id").cast("string"))
    cents = F.when(F.isnan("total") | (F.abs("total") > 9e16), None).otherwise(F.floor(100 * F.col("total") + 0.5).cast("long"))
    rows = sales.select(F.col("client_id").cast("long"), floored(micros(sales, "sold_at"), h).alias("at_us"), F.col("priority").cast("int"), F.col("sale_id").cast("long"), cents.alias("total_cents"), (h % 3 != 0).alias("two"))
    second = F.array(F.struct((6 - F.col("priority")).alias("priority"), (-1 - F.col("sale_id")).alias("sale_id")))
    first = F.array(F.struct("priority", "sale_id"))
    each = rows.select("client_id", "at_us", "total_cents", F.explode(F.when(F.col("two"), F.concat(first, second)).otherwise(first)).alias("o"))
    return each.select("client_id", "at_us", "o.priority", "o.sale_id", "total_cents")


def match_clicks(clicks: DataFrame, sales: DataFrame, hours: int = 72) -> DataFrame:
    """Each click with the latest order of its client at or before it, at most some hours old."""
    out = tolerant_asof(clicks_once(clicks), orders_of(sales), "client_id", "ts_us", "at_us", hours * HOUR_US, [-F.col("priority"), F.col("sale_id")], ["sale_id", "total_cents"])
    return out.select("click_id", "client_id", "ts_us", "match.sale_id", (F.col("ts_us") - F.col("match.at_us")).alias("lag_us"), "match.total_cents", F.coalesce("match.n_tied", F.lit(0)).cast("long").alias("n_tied"))


#: Unsigned crc32 of a string of ASCII signs.
_CRC = "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT), lambda c, b: list_reduce(range(8), lambda x, j: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"

ORACLE = f"""
with ch as (select click_id, client_id, case when {_CRC.format("click_id::varchar")} % 2 = 1 then t - ((t % {DAY_US}) + {DAY_US}) % {DAY_US} else t end ts_us from (select distinct on (click_id) click_id, client_id, epoch_us(ts) t from clicks)),
s as (select client_id, sale_id, priority, total, epoch_us(sold_at) t, {_CRC.format("sale_id::varchar")} h from sales),
f as (select client_id, sale_id, priority, floor(100 * total + 0.5)::bigint total_cents, h, case when h % 2 = 1 then t - ((t % {DAY_US}) + {DAY_US}) % {DAY_US} else t end at_us from s),
o as (select client_id, sale_id, priority, total_cents, at_us from f union all select client_id, -1 - sale_id, 6 - priority, total_cents, at_us from f where h % 3 <> 0),
g as (select client_id, at_us, count(*) n_tied, first(sale_id order by priority desc nulls last, sale_id nulls last) sale_id, first(total_cents order by priority desc nulls last, sale_id nulls last) total_cents from o where client_id is not null and at_us is not null group by all)
select ch.click_id, ch.client_id, ch.ts_us, m.sale_id, ch.ts_us - m.at_us lag_us, m.total_cents, coalesce(m.n_tied, 0)::bigint n_tied
from ch left join (select k.click_id, g.* from ch k join g on g.client_id = k.client_id and g.at_us between k.ts_us - {72 * HOUR_US} and k.ts_us qualify row_number() over (partition by k.click_id order by g.at_us desc) = 1) m on m.click_id = ch.click_id
"""
