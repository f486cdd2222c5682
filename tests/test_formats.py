"""Formats of the Python data source interface: what is written comes back, in several partitions, with filters pushed down."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

from dispatchgrid import catalog
from dispatchgrid.sources import formats
from tests.conftest import DATA


@pytest.fixture(scope="module")
def registered(spark):
    formats.register(spark)
    return spark


def squares(spark, n=500):
    ring = "array(array(named_struct('x', id * 1.0D, 'y', 0D), named_struct('x', id * 1.0D, 'y', 1D), named_struct('x', id + 1.0D, 'y', 1D), named_struct('x', id * 1.0D, 'y', 0D)))"
    return spark.range(n).selectExpr("'g' || id as id", f"{ring} as rings")


def test_shapes(registered, tmp_path):
    spark, at = registered, f"file://{tmp_path}/shapes"
    squares(spark).repartition(3).write.format("polygon_shapes").mode("append").save(at)
    back = spark.read.format("polygon_shapes").option("blockBytes", 4096).load(at)
    assert back.rdd.getNumPartitions() > 10
    rows = {r["id"]: r for r in back.collect()}
    assert len(rows) == 500 and rows["g7"]["xmin"] == 7.0 and rows["g7"]["attributes"] == {"GEOID": "g7"}
    assert [tuple(p) for p in rows["g7"]["rings"][0]] == [(7.0, 0.0), (7.0, 1.0), (8.0, 1.0), (7.0, 0.0)]
    some = back.where(F.col("id").isin("g3", "g400") | F.col("id").isin("g5")).where("xmax < 100")
    assert sorted(r["id"] for r in some.collect()) == ["g3", "g5"]
    plan = back.where("xmin >= 490")._jdf.queryExecution().executedPlan().toString()
    assert back.where("xmin >= 490").count() == 10 and "490" not in plan, "the reader takes the comparison over"


def test_a_reader_decodes_only_what_its_filters_ask_for(registered, tmp_path):
    at = f"file://{tmp_path}/shapes"
    squares(registered).coalesce(1).write.format("polygon_shapes").mode("append").save(at)
    reader = formats._ShapeReader({"path": at, "blockBytes": "4096"})
    left = list(reader.pushFilters([In(("id",), ("g1", "g2", "g499")), LessThan(("xmax",), 100.0), GreaterThanOrEqual(("shape",), 0)]))
    assert [type(f) for f in left] == [GreaterThanOrEqual]
    blocks = reader.partitions()
    assert [b.first for b in blocks[1:]] == [b.stop for b in blocks[:-1]] and blocks[-1].stop == 500
    assert [r[0] for b in blocks for r in reader.read(b)] == ["g1", "g2"]


def test_sheets(registered, tmp_path):
    spark, at = registered, f"file://{tmp_path}/sheets"
    spark.range(100).selectExpr("map('A', string(id), 'B <&>', if(id % 3 = 0, null, 'v ' || id)) as values").repartition(2).write.format("sheet_rows").mode("append").save(at)
    back = spark.read.format("sheet_rows").option("blockRows", 7).load(at)
    assert back.rdd.getNumPartitions() >= 15
    got = {r["values"]["A"]: r["values"].get("B <&>") for r in back.collect()}
    assert got == {str(i): None if i % 3 == 0 else f"v {i}" for i in range(100)}
    assert back.where("row < 5").count() == 10


def test_blocks_of_a_sheet_take_time_by_its_length(spark, tmp_path, monkeypatch):
    """Rows parsed for all blocks together stay within a few times the sheet, and none is parsed to plan them; a sheet that
    says too little of its rows is read whole."""
    at, n = f"file://{tmp_path}/sheets", 3000
    monkeypatch.setattr(formats, "SHEET_ROWS", 2000)
    formats._SheetWriter({"path": at}).write(iter([{"values": {"A": str(i), "B": "<b>"}} for i in range(n)]))
    seen, rows = [0], formats._rows
    monkeypatch.setattr(formats, "_rows", lambda z, sheet: (seen.__setitem__(0, seen[0] + 1) or r for r in rows(z, sheet)))
    reader = formats._SheetReader({"path": at, "blockRows": "10"})
    blocks = reader.partitions()
    assert seen == [0] and len({b.file for b in blocks}) == 2
    assert sorted(int(r[2]["A"]) for b in blocks for r in reader.read(b)) == list(range(n)) and seen[0] < 6 * n
    monkeypatch.setattr(formats, "_length", lambda z, sheet: 100)
    assert sorted(int(r[2]["A"]) for b in reader.partitions() for r in reader.read(b)) == list(range(n))


def test_rows_before_a_block_are_passed_over_as_bytes(tmp_path):
    """Only a block's own rows are parsed, whatever stands between the rows: comments, plain text like a row's end, empty rows, prefixes."""
    text = lambda i: f"<![CDATA[</row>{i}]]>" if i % 7 == 0 else f"{i}" + "x" * (i % 11)
    line = lambda i: '<x:row r="1" y=\'>\'/>' if i % 13 == 5 else f'<x:row r="{i}"><x:c t="inlineStr"><x:is><x:t>{text(i)}</x:t></x:is></x:c></x:row >' + "<!-- </x:row> -->" * (i % 5 == 0)
    body = f'<x:worksheet xmlns:x="{formats._NS[1:-1]}"><x:sheetData><x:row><x:c t="inlineStr"><x:is><x:t>A</x:t></x:is></x:c></x:row>' + "".join(map(line, range(30000))) + "</x:sheetData></x:worksheet>"
    for kind in ("utf-8", "utf-16"):
        with zipfile.ZipFile(f"{tmp_path}/{kind}.xlsx", "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="{kind}"?>'.encode(kind) + body.encode(kind)[2 * (kind == "utf-16") :])
    want = {i: (f"</row>{i}" if i % 7 == 0 else text(i)) for i in range(30000) if i % 13 != 5}
    reader = formats._SheetReader({"path": str(tmp_path)})
    for name in ("utf-8", "utf-16"):
        for first, stop in ((0, 4), (1, 3), (29000, 29010), (29998, 10**9), (40000, 10**9)):
            got = [(i, v.get("A")) for _, i, v in reader.read(formats.Block(f"{tmp_path}/{name}.xlsx", first, stop))]
            assert got == [(i, want.get(i)) for i in range(first, min(stop, 30000))], (name, first)
    with zipfile.ZipFile(f"{tmp_path}/utf-8.xlsx") as z:
        assert [i for i, _ in formats._rows_from(z, 1, 29990)] == [0, *range(29991, 30001)]


def test_all_orders_are_in_the_sheets(registered):
    """Three of four orders were left out."""
    got = catalog.queries()["a8_sheet_rows"](registered, DATA).agg(F.sum("orders").alias("n")).first()["n"]
    assert got == registered.read.parquet(f"{DATA}/orders.parquet").count()


def test_tiles(registered, tmp_path):
    spark, at = registered, f"file://{tmp_path}/tiles"
    cells = spark.range(600).selectExpr("int(id % 20) as ix", "int(id / 20) - 5 as iy", "float(id) as value").where("value <> 77")
    cells.repartitionByRange(3, "iy").write.format("grid_tiles").option("cellSize", 0.5).mode("append").save(at)
    back = spark.read.format("grid_tiles").option("blockRows", 2).load(at)
    assert back.rdd.getNumPartitions() >= 15
    assert {(r["ix"], r["iy"]): r["value"] for r in back.collect()} == {(i % 20, i // 20 - 5): float(i) for i in range(600) if i != 77}
    one = back.where("ix = 3 and iy = -2").collect()
    assert [(r["x"], r["y"], r["value"]) for r in one] == [(1.75, -0.75, 63.0)]


def test_folders_without_files(registered, tmp_path):
    for kind in ("polygon_shapes", "sheet_rows", "grid_tiles"):
        assert registered.read.format(kind).load(f"file://{tmp_path}").count() == 0
