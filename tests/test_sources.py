import json
import zipfile

import pytest
from pyspark.sql import functions as F

from dispatchgrid.sources import files
from dispatchgrid.streaming.dispatch import dispatch_batches
from tests.conftest import DATA


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("A,Total!!Pop\nB,Name\n")
    (tmp_path / "d.csv").write_text("A,B\n1,x\n")
    assert files.census_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "d.csv")).columns == ["Total Pop", "Name"]
    (tmp_path / "p.csv").write_text("GEO_ID,B02001_001E\n1500000US1,10\n1500000US2,n/a\n")
    assert [tuple(r) for r in files.population_csv(spark, str(tmp_path / "none.csv"), str(tmp_path / "p.csv")).collect()] == [("1500000US1", 10.0)]
    (tmp_path / "u.csv").write_text("lat,lon,avg_ons,avg_offs\n1,2,3,\n,2,3,4\n")
    assert [tuple(r) for r in files.stop_usage_csv(spark, str(tmp_path / "u.csv")).collect()] == [(1.0, 2.0, 3.0)]
    (tmp_path / "ids.txt").write_text("a \n\n b\n")
    assert [r[0] for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    (tmp_path / "pop.json").write_text(json.dumps({"x": 1, "y": 2}))
    assert {tuple(r) for r in files.population_json(spark, str(tmp_path / "pop.json")).collect()} == {("x", 1), ("y", 2)}
    (tmp_path / "routes.json").write_text(json.dumps([{"RouteID": 7, "Stops": [{"Latitude": 1.0, "Longitude": 2.0, "Description": "s", "SecondsToNextStop": 9.0}]}]))
    assert [tuple(r) for r in files.routes_json(spark, str(tmp_path / "routes.json")).collect()] == [("Route 7", 0, 1.0, 2.0, "s", 9.0)]
    (tmp_path / "runs/a").mkdir(parents=True)
    (tmp_path / "runs/a/setting_1.json").write_text(json.dumps({"row": {"k": 1, "c": 2.5}}))
    (tmp_path / "runs/a/setting_2.json").write_text(json.dumps({"row": None}))
    assert [r["c"] for r in files.result_rows(spark, str(tmp_path / "runs")).collect()] == [2.5]
    with zipfile.ZipFile(tmp_path / "gtfs_1.zip", "w") as z:
        z.writestr("sub/stops.txt", "stop_id,stop_lat\ns1,40.5\n")
    (tmp_path / "gtfs_0.zip").write_bytes(b"")
    path = files.newest(spark, f"{tmp_path}/gtfs_*.zip")
    assert [(r["stop_id"], r["stop_lat"]) for r in files.gtfs_member(spark, path, "stops.txt").collect()] == [("s1", "40.5")]
    with pytest.raises(FileNotFoundError):
        files.newest(spark, f"{tmp_path}/nothing*")
    files.write_results(spark.range(3).withColumn("b", F.lit("x")), str(tmp_path / "out"), "b")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_polyline(spark):
    got = spark.range(1).select(files.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")).alias("v")).first()["v"]
    assert [(round(p["lat"], 3), round(p["lon"], 3)) for p in got] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_stream_agrees_with_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").limit(500).withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = dispatch_batches(s).writeStream.format("memory").queryName("batches").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = dispatch_batches(e).collect()
    assert {tuple(r) for r in spark.table("batches").collect()} == {tuple(r) for r in want}


def test_polyline_written(spark):
    line = spark.createDataFrame([([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)],), ([],), ([(0.0, 0.0), (-90.0, 180.0), (90.0, -180.0)],)], "p array<struct<lat:double,lon:double>>").select(files.encode_polyline("p").alias("l"), "p")
    rows = line.select("l", "p", files.decode_polyline("l").alias("back")).collect()
    assert rows[0]["l"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and rows[1]["l"] == ""
    assert all([tuple(v) for v in r["p"]] == [tuple(v) for v in r["back"]] for r in rows)
