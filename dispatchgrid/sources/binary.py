"""Readers of polygon shapefiles and spreadsheets, and results kept under a key.

Files are read by Spark as bytes and parsed on executors, one file a row; a file has the size of a region's map or of a
month's sheet.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POLYGONS = "file string, shape int, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>"
#: Characters of an id's end that name a unit of each level within its county.
LEVELS = {"tract": 6, "block_group": 7, "block": 10}


def _attributes(dbf: bytes) -> list[dict]:
    """Records of a dBase table, blanks cut off; those marked as deleted are None."""
    n, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, pos = dbf[head + i * width : head + (i + 1) * width], 1
        values = {}
        for name, size in fields:
            values[name] = row[pos : pos + size].decode("utf-8", "replace").strip()
            pos += size
        out.append(None if row[:1] == b"*" else values)
    return out


def _rings(shp: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """Rings of each polygon, with or without heights or measures; None for an empty shape."""
    at = 100
    while at < len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        kind = struct.unpack_from("<i", shp, at + 8)[0]
        if kind == 0:
            yield None
        elif kind in (5, 15, 25):
            parts, points = struct.unpack_from("<ii", shp, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", shp, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", shp, at + 52 + 4 * parts)
            yield [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            raise ValueError(f"shape type {kind} is no polygon")
        at += 8 + size


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """file, shape, attributes, rings: the polygons of every .shp with a .dbf beside it that path matches."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"^(.*)\.(\w+)$", 1).alias("file"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    pair = files.where(F.col("kind").isin("shp", "dbf")).groupBy("file").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, shp, dbf in zip(f["file"], f["shp"], f["dbf"], strict=True):
                rows = [(name, i, a, [[{"x": x, "y": y} for x, y in ring] for ring in r]) for i, (r, a) in enumerate(zip(_rings(shp), _attributes(dbf), strict=True)) if r is not None and a is not None]
                yield pd.DataFrame(rows, columns=["file", "shape", "attributes", "rings"])

    return pair.where("shp is not null and dbf is not null").mapInPandas(run, _POLYGONS)


def region_units(polygons: DataFrame, ids: list[str], level: str = "block_group", field: str = "GEOID") -> DataFrame:
    """unit, geoid, rings of the listed ids. Tracts are matched by their end; block groups and blocks by the whole id before
    it is cut, since ends recur from county to county. Of one id the first shape stays."""
    if level not in LEVELS:
        raise ValueError(f"level {level!r} is none of {', '.join(LEVELS)}")
    g = polygons.select(F.element_at("attributes", field).alias("geoid"), "shape", "rings").withColumn("unit", F.right("geoid", F.lit(LEVELS[level])))
    kept = g.where(F.col("unit").isin([i[-LEVELS[level] :] for i in ids]) if level == "tract" else F.col("geoid").isin(list(ids)))
    first = kept.groupBy("geoid").agg(F.min("shape").alias("shape"))
    return kept.join(first, ["geoid", "shape"]).select("unit", "geoid", "rings")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _sheet(content: bytes, number: int) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{_NS}row"):
            out: list[str | None] = []
            for k, cell in enumerate(row.iter(f"{_NS}c")):
                at = _column(cell.get("r")) if cell.get("r") else k
                out += [None] * (at + 1 - len(out))
                value = cell.find(f"{_NS}v")
                if cell.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                elif value is not None:
                    out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield out


def spreadsheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """file, row, values: the rows below the first of a sheet, as a map by the first row's names; empty cells are absent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows = _sheet(content, sheet)
                head = next(rows, [])
                out = [(name, i, {h: v for h, v in zip(head, r, strict=False) if h is not None and v is not None}) for i, r in enumerate(rows)]
                yield pd.DataFrame(out, columns=["file", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row int, values map<string,string>")


def sheet_time(days: Column) -> Column:
    """The time that a spreadsheet's count of days since 1899-12-30 stands for."""
    return F.timestamp_micros(F.round((days.cast("double") - 25569) * 86400e6 / 1e3).cast("bigint") * 1000)


def kept_under_key(spark: SparkSession, root: str, parts: list, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that is kept under a digest of its parameters below root; built and written where it isn't there yet."""
    import hashlib

    path = f"{root}/{hashlib.sha1('|'.join(map(str, parts)).encode()).hexdigest()}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
