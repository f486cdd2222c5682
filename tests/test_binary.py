"""Shapefiles, spreadsheets and kept results, on files made here byte by byte."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from dispatchgrid.sources import binary


def write_shapes(folder, rows):
    body = b""
    for i, rings in enumerate(rows):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            content = struct.pack("<i4dii", 5, 0, 0, 1, 1, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", i + 1, len(content) // 2) + content
    (folder / "map.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 0) + b"\0" * 72 + body)


def write_table(folder, ids):
    fields = b"GEOID".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([12, 0]) + b"\0" * 14 + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    rows = b"".join(b" " + i.encode().ljust(12) + f"n{k}".encode().ljust(6) for k, i in enumerate(ids))
    (folder / "map.dbf").write_bytes(struct.pack("<B3BIHH", 3, 1, 1, 1, len(ids), 32 + 64 + 1, 19) + b"\0" * 20 + fields + b"\r" + rows)


def test_shapefile(spark, tmp_path):
    square = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]]
    holed = [*square, [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)]]
    ids = ["420030001001", "420030001002", "420050001001", "420030001001", "420030002001"]
    write_shapes(tmp_path, [square, holed, square, holed, None])
    write_table(tmp_path, ids)
    p = binary.shapefile(spark, str(tmp_path))
    rows = {r["shape"]: r for r in p.collect()}
    assert sorted(rows) == [0, 1, 2, 3] and rows[1]["attributes"] == {"GEOID": ids[1], "NAME": "n1"} and len(rows[1]["rings"]) == 2
    assert [(q["x"], q["y"]) for q in rows[1]["rings"][1]] == holed[1]
    groups = binary.region_units(p, [ids[0], ids[1]]).collect()
    assert sorted((r["unit"], r["geoid"], len(r["rings"])) for r in groups) == [("0001001", ids[0], 1), ("0001002", ids[1], 2)]
    assert {r["unit"] for r in binary.region_units(p.withColumn("attributes", F.create_map(F.lit("GEOID"), F.left(F.element_at("attributes", "GEOID"), F.lit(11)))), ["42003000100"], "tract").collect()} == {"000100"}
    with pytest.raises(ValueError):
        binary.region_units(p, ids, "county")


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "rides.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si><si><t>Pgr On</t></si><si><r><t>two</t></r><r><t> runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>44927.5</v></c><c r="C2"><v>3</v></c></row><row><c r="C3" t="s"><v>2</v></c></row><row><c r="A4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    s = binary.spreadsheet(spark, str(tmp_path / "rides.xlsx"))
    rows = [r["values"] for r in s.orderBy("row").collect()]
    assert rows == [{"Date": "44927.5", "Pgr On": "3"}, {"Pgr On": "two runs"}, {"Date": "x"}]
    t = s.where("row = 0").select(F.date_format(binary.sheet_time(F.element_at("values", "Date")), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    assert t == "2023-01-01 12:00:00"


def test_results_are_kept_under_their_key(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    root = str(tmp_path)
    for n in (3, 3, 4):
        assert binary.kept_under_key(spark, root, ["range", n], lambda n=n: build(n)).count() == n
    assert built == [3, 4]
