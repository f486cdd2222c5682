"""Readers and writers of the file kinds that the region's data come in.

Every reader takes a path that Spark resolves, so inputs may lie in any store; nothing is opened on the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUTES = "array<struct<Description:string,RouteID:bigint,EncodedPolyline:string,MapLineColor:string,Stops:array<struct<Latitude:double,Longitude:double,Description:string,SecondsToNextStop:double>>>>"


def census_csv(spark: SparkSession, meta_path: str, data_path: str) -> DataFrame:
    """A survey table whose columns are named by a metadata file of (code, label) rows; '!!' in labels becomes a blank."""
    meta = {r[0]: r[1].replace("!!", " ").strip() for r in spark.read.csv(meta_path).toLocalIterator() if r[0] and r[1]}
    return spark.read.csv(data_path, header=True).withColumnsRenamed(meta)


def population_csv(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """geoid, population: columns found by name, all read as text; rows without a number are dropped."""
    try:
        df = spark.read.csv(path, header=True)
    except Exception:
        if fallback is None:
            raise
        df = spark.read.csv(fallback, header=True)
    key = next(c for c in df.columns if c.startswith("Geography") or c == "GEO_ID")
    value = next(c for c in df.columns if c.startswith("Estimate Total") or c == "B02001_001E")
    return df.select(F.col(f"`{key}`").alias("geoid"), F.col(f"`{value}`").try_cast("double").alias("population")).dropna(subset=["population"])


def stop_usage_csv(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, activity: boardings and alightings, nulls as none; rows without coordinates are dropped."""
    df = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in df.columns}

    def pick(*wanted: str):
        for w in wanted:
            if w in names:
                return F.col(f"`{names[w]}`").try_cast("double")
        return F.col(f"`{next(c for k, c in names.items() if wanted[-1] in k)}`").try_cast("double")

    zero = F.lit(0.0)
    out = df.select(pick("latitude", "lat").alias("lat"), pick("longitude", "lon").alias("lon"), (F.coalesce(pick("avg_ons", "on"), zero) + F.coalesce(pick("avg_offs", "off"), zero)).alias("activity"))
    return out.dropna(subset=["lat", "lon"])


def gtfs_member(spark: SparkSession, zip_path: str, member: str) -> DataFrame:
    """A table inside a GTFS archive, wherever in it the member lies; unpacked on an executor."""
    import csv
    import io
    import zipfile

    def rows(frames):
        for f in frames:
            for content in f["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.rsplit("/", 1)[-1] == member), None)
                    if name is not None:
                        yield pd.DataFrame({"row": [dict(r) for r in csv.DictReader(io.TextIOWrapper(z.open(name), "utf-8-sig"))]})

    m = spark.read.format("binaryFile").load(zip_path).select("content").mapInPandas(rows, "row map<string,string>")
    head = m.limit(1).collect()
    keys = list(head[0]["row"]) if head else []
    return m.select(*(F.element_at("row", k).alias(k) for k in keys))


def newest(spark: SparkSession, pattern: str) -> str:
    """The file that sorts last among those that match."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(str(s.getPath()) for s in found)
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def routes_json(spark: SparkSession, path: str) -> DataFrame:
    """route, seq, lat, lon, name, secs: the stops of each route in order; a route without a description is 'Route <id>'."""
    r = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", ROUTES)))
    name = F.coalesce("Description", F.concat(F.lit("Route "), F.col("RouteID").cast("string")))
    s = r.select(name.alias("route"), F.posexplode("Stops").alias("seq", "s"))
    return s.select("route", "seq", F.col("s.Latitude").alias("lat"), F.col("s.Longitude").alias("lon"), F.col("s.Description").alias("name"), F.col("s.SecondsToNextStop").alias("secs"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("geoid")).where("length(geoid) > 0")


def population_json(spark: SparkSession, path: str) -> DataFrame:
    """geoid, population of one JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("geoid", "population"))


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all settings below a folder; settings without one are skipped."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "setting_*.json").option("multiLine", "true").json(folder).select("row.*").dropna(how="all")


def write_results(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("header", "true").partitionBy(*by).csv(path)


def decode_polyline(column):
    """Vertices of encoded polylines, as an Arrow function: the format's running state isn't an expression."""
    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def decode(lines: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at, place = [], [0, 0], 0
            while place < len(text):
                for k in (0, 1):
                    shift = value = 0
                    while True:
                        c = ord(text[place]) - 63
                        place += 1
                        value |= (c & 31) << shift
                        shift += 5
                        if c < 32:
                            break
                    at[k] += ~(value >> 1) if value & 1 else value >> 1
                out.append({"lat": at[0] / 1e5, "lon": at[1] / 1e5})
            return out

        return lines.map(one)

    return decode(column)


def encode_polyline(points):
    """Encoded polylines of arrays of (lat, lon): five places, differences with the sign last, five bits a character."""
    whole = F.transform(points, lambda v: F.struct(F.round(v["lat"] * 100000).cast("long").alias("lat"), F.round(v["lon"] * 100000).cast("long").alias("lon")))

    def number(n):
        z = F.when(n < 0, -2 * n - 1).otherwise(2 * n)
        last = F.ceil(F.greatest(F.length(F.bin(z)), F.lit(1)) / 5).cast("int") - 1
        # Shifts of a literal aren't defined for columns, so places are powers of 32; a polyline's numbers have seven at most.
        place = lambda k: F.floor(z / F.pow(F.lit(32.0), k)).cast("long") % 32
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda k: F.char(place(k) + F.when(k < last, 95).otherwise(63))), "")

    def step(v, i):
        before = lambda c: F.when(i > 0, F.get(whole, i - 1)[c]).otherwise(F.lit(0))
        return F.concat(number(v["lat"] - before("lat")), number(v["lon"] - before("lon")))

    return F.array_join(F.transform(whole, step), "")
