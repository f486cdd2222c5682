"""The file sources as queries: a table of the region written in a source's format to the shared folder and read back."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchgrid.catalog import query
from dispatchgrid.plans.region import Region, sql
from dispatchgrid.sources import files


def scratch(spark: SparkSession, what: str) -> str:
    """A folder below the shared one; a temporary one only where none is set and all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="dispatchgrid-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: str | bytes) -> str:
    """A small file of an exact name, written through Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()
    return path


def lines(df: DataFrame, *columns: str) -> str:
    """Rows of the region's size as text lines."""
    return "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in df.select(*columns).orderBy(columns[0]).collect())


@query("a2_survey_table", "select n_nationkey::varchar as \"Geography id\", n_name as \"Label name\" from nation")
def a2(spark, sf_dir):
    n, base = Region(spark, sf_dir).table("nation"), scratch(spark, "a2")
    meta = put(spark, f"{base}/meta.csv", "A001,Geography!!id\nA002,Label!!name\n")
    return files.census_csv(spark, meta, put(spark, f"{base}/data.csv", "A001,A002\n" + lines(n, "n_nationkey", "n_name")))


def _population(spark, sf_dir) -> str:
    c = Region(spark, sf_dir).table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = c.select(F.concat(F.lit("1500000US"), F.lpad(F.col("c_nationkey").cast("string"), 12, "0")).alias("id"), F.when(F.col("c_nationkey") % 6 == 5, "-").otherwise(F.col("n").cast("string")).alias("n"))
    return "GEO_ID,B02001_001E,NAME\n" + lines(rows.withColumn("x", F.lit("name")), "id", "n", "x")


_POP = "select '1500000US' || lpad(c_nationkey::varchar, 12, '0') as geoid, count(*)::double as population from customer where c_nationkey % 6 <> 5 group by c_nationkey"


@query("a3_population_table", _POP)
def a3(spark, sf_dir):
    return files.population_csv(spark, put(spark, f"{scratch(spark, 'a3')}/pop.csv", _population(spark, sf_dir)))


@query("a4_population_fallback", _POP)
def a4(spark, sf_dir):
    base = scratch(spark, "a4")
    return files.population_csv(spark, f"{base}/missing.csv", put(spark, f"{base}/fallback.csv", _population(spark, sf_dir)))


@query("a5_stop_usage", "select round(40 + s_suppkey / 1000.0, 3)::double as lat, -80.0::double as lon, (case when s_suppkey % 3 = 0 then 0 else s_suppkey % 10 end + s_suppkey % 4)::double as activity from supplier where s_suppkey % 7 <> 0")
def a5(spark, sf_dir):
    k = F.col("s_suppkey")
    s = Region(spark, sf_dir).table("supplier").select(
        F.when(k % 7 != 0, F.round(40 + k / 1000.0, 3)).alias("lat"), F.lit(-80.0).alias("lon"), F.when(k % 3 != 0, k % 10).alias("avg_ons"), (k % 4).alias("avg_offs")
    )
    path = f"{scratch(spark, 'a5')}/usage"
    s.write.option("header", True).csv(path)
    return files.stop_usage_csv(spark, path)


@query("a7_newest_file", "select 'feed_' || max(n_name) || '.zip' as name from nation")
def a7(spark, sf_dir):
    base = scratch(spark, "a7")
    for r in Region(spark, sf_dir).table("nation").select("n_name").collect():
        put(spark, f"{base}/feed_{r['n_name']}.zip", "")
    return spark.createDataFrame([(files.newest(spark, f"{base}/feed_*.zip").rsplit("/", 1)[-1],)], "name string")


@query("a6_schedule_archive", sql("select stop, hour, round(count(distinct trip)::double / count(distinct service), 6) as trips from (select s_suppkey as stop, (s_suppkey + k) % 24 as hour, s_suppkey * 10 + k as trip, k % 2 as service from supplier, (select unnest(range(6)) as k)) group by stop, hour"))
def a6(spark, sf_dir):
    """Trips an hour by stop from the members of an archive: stop times joined to trips, hours past midnight wrapped."""
    stops = [r["s_suppkey"] for r in Region(spark, sf_dir).table("supplier").select("s_suppkey").orderBy("s_suppkey").collect()]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("feed/trips.txt", "route_id,service_id,trip_id\n" + "".join(f"r,{k % 2},{s * 10 + k}\n" for s in stops for k in range(6)))
        z.writestr("feed/stop_times.txt", "trip_id,stop_id,arrival_time\n" + "".join(f"{s * 10 + k},{s},{(s + k) % 24 + 24 * (k == 5):02d}:10:00\n" for s in stops for k in range(6)))
    path = put(spark, f"{scratch(spark, 'a6')}/gtfs_1.zip", raw.getvalue())
    t = files.gtfs_member(spark, path, "stop_times.txt").join(files.gtfs_member(spark, path, "trips.txt"), "trip_id")
    hour = (F.split_part("arrival_time", F.lit(":"), F.lit(1)).cast("int") % 24).cast("bigint")
    g = t.groupBy(F.col("stop_id").cast("bigint").alias("stop"), hour.alias("hour")).agg(F.count_distinct("trip_id").alias("n"), F.count_distinct("service_id").alias("s"))
    return g.select("stop", "hour", F.round(F.col("n") / F.col("s"), 6).alias("trips"))


@query("a10_id_list", "select n_name as geoid from nation")
def a10(spark, sf_dir):
    text = "".join(f"  {r['n_name']} \n\n" for r in Region(spark, sf_dir).table("nation").select("n_name").collect())
    return files.id_list(spark, put(spark, f"{scratch(spark, 'a10')}/ids.txt", text))


@query("a12_result_files", "select n_nationkey as setting, n_regionkey * 1.5::double as cost from nation where n_nationkey % 5 <> 3")
def a12(spark, sf_dir):
    base = scratch(spark, "a12")
    for r in Region(spark, sf_dir).table("nation").select("n_nationkey", "n_regionkey").collect():
        row = {"setting": r["n_nationkey"], "cost": r["n_regionkey"] * 1.5} if r["n_nationkey"] % 5 != 3 else None
        put(spark, f"{base}/run{r['n_regionkey']}/setting_{r['n_nationkey']}.json", json.dumps({"row": row}, indent=1))
    return files.result_rows(spark, base).select(F.col("setting").cast("int").alias("setting"), "cost")


@query("a17_table_sink", "select o_orderstatus as status, count(*)::bigint as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus")
def a17(spark, sf_dir):
    """Orders written as text partitioned by status, read back and summed."""
    path = f"{scratch(spark, 'a17')}/orders"
    files.write_results(Region(spark, sf_dir).table("orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status")), path, "status")
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query("a19_kept_table", "select o_custkey, count(*)::bigint as n from orders group by o_custkey")
def a19(spark, sf_dir):
    """Counts built once under the digest of their parameters; the second look reads them."""
    from dispatchgrid.sources.binary import kept_under_key

    base = scratch(spark, "a19")
    build = lambda: Region(spark, sf_dir).table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    kept_under_key(spark, base, [sf_dir, "orders"], build)
    return kept_under_key(spark, base, [sf_dir, "orders"], lambda: build().limit(0))
