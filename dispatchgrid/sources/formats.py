"""Binary files of the region as Spark formats, by the Python data source interface.

  polygon_shapes   folders of .shp/.shx/.dbf: a partition is a run of records found in the index file; ids (option `idField`)
                   and boxes in a filter are pushed down, so that shapes outside aren't decoded
  sheet_rows       .xlsx: a partition is a block of a sheet's rows, parsed as a stream; the rows before it are passed over as
                   bytes, and a sheet has SHEET_BLOCKS at most, so that all blocks together take time by its length
  grid_tiles       folders of .flt tiles with a .hdr each: a partition is a block of a tile's rows, read at its offset; bounds
                   on ix and iy are pushed down

Writing gives a file (or tile) a task; sheets a workbook for each SHEET_ROWS rows of a task. Paths are resolved by pyarrow's file systems, on the driver for planning and on
executors for reading, so they may lie in any store that these know. Use `register(spark)` once a session.
"""

from __future__ import annotations

import itertools
import re
import struct
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from dispatchgrid.sources.binary import _NS, _column

#: Bytes of shapes, and rows of sheets and tiles, that a partition has unless an option says otherwise.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 50_000
#: Rows of a written workbook, and blocks of a sheet, at most.
SHEET_ROWS, SHEET_BLOCKS = 50_000, 8
_BOUNDS = {GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, EqualTo: lambda v, w: v == w, In: lambda v, w: v in w}


def register(spark: SparkSession) -> None:
    for source in (PolygonShapes, SheetRows, GridTiles):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _files(path: str, ending: str) -> tuple[pafs.FileSystem, list[str]]:
    store, at = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    names = [at] if info.is_file else sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.is_file)
    return store, [n for n in names if n.lower().endswith(ending)]


class _Filtered(DataSourceReader):
    """A reader that takes over comparisons of some columns with constants; the others stay with Spark."""

    takes: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _BOUNDS and f.attribute[0] in self.takes and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], type(f), list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def passes(self, **values) -> bool:
        return all(_BOUNDS[kind](values[name], w) for name, kind, w in self.tests if name in values)


@dataclass
class Block(InputPartition):
    file: str
    first: int
    stop: int


# --- polygon shapes --------------------------------------------------------------------------------------------------------


class PolygonShapes(DataSource):
    @classmethod
    def name(cls):
        return "polygon_shapes"

    def schema(self):
        return "id string, file string, shape int, xmin double, ymin double, xmax double, ymax double, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>"

    def reader(self, schema):
        return _ShapeReader(self.options)

    def writer(self, schema, overwrite):
        return _ShapeWriter(self.options)


def _fields(head: bytes) -> tuple[int, int, list[tuple[str, int]]]:
    """Length of the head, width of a record, and fields of a dBase table."""
    size, width = struct.unpack_from("<HH", head, 8)
    fields = [(head[at : at + 11].split(b"\0")[0].decode(), head[at + 16]) for at in range(32, size - 1, 32) if head[at] != 0x0D]
    return size, width, fields


class _ShapeReader(_Filtered):
    takes = ("id", "xmin", "ymin", "xmax", "ymax")

    def partitions(self):
        store, names = _files(self.options["path"], ".shp")
        most, out = int(self.options.get("blockBytes", BLOCK_BYTES)), []
        for name in names:
            index = np.frombuffer(store.open_input_file(name[:-4] + ".shx").read()[100:], ">i4").reshape(-1, 2)
            block = np.cumsum(8 + 2 * index[:, 1].astype(np.int64)) // most
            for b in np.unique(block):
                own = np.flatnonzero(block == b)
                out.append(Block(name, int(own[0]), int(own[-1]) + 1))
        return out or [Block("", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        store, _ = _files(self.options["path"], ".shp")
        base, first, n = partition.file[:-4], partition.first, partition.stop - partition.first
        with store.open_input_file(base + ".shx") as f:
            f.seek(100 + 8 * first)
            index = np.frombuffer(f.read(8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with store.open_input_file(base + ".dbf") as f:
            head = f.read(12)
            size, width, fields = _fields(head + f.read(struct.unpack_from("<H", head, 8)[0] - 12))
            f.seek(size + width * first)
            table = f.read(width * n)
        with store.open_input_file(partition.file) as f:
            f.seek(int(index[0, 0]))
            shapes = f.read(int(index[-1].sum() + 8 - index[0, 0]))
        for k in range(n):
            row = table[k * width : (k + 1) * width]
            at = int(index[k, 0] - index[0, 0]) + 8
            kind = struct.unpack_from("<i", shapes, at)[0]
            if row[:1] == b"*" or kind == 0:
                continue
            if kind not in (5, 15, 25):
                raise ValueError(f"shape type {kind} is no polygon")
            attributes, pos = {}, 1
            for name, w in fields:
                attributes[name] = row[pos : pos + w].decode("utf-8", "replace").strip()
                pos += w
            id_ = attributes.get(self.options.get("idfield", self.options.get("idField", "GEOID")))
            box = struct.unpack_from("<4d", shapes, at + 4)
            if not self.passes(id=id_, xmin=box[0], ymin=box[1], xmax=box[2], ymax=box[3]):
                continue
            parts, points = struct.unpack_from("<ii", shapes, at + 36)
            starts = [*struct.unpack_from(f"<{parts}i", shapes, at + 44), points]
            xy = struct.unpack_from(f"<{2 * points}d", shapes, at + 44 + 4 * parts)
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            yield (id_, partition.file, first + k, *box, attributes, rings)


class _ShapeWriter(DataSourceWriter):
    """A shapefile a task, of rows (id, rings, ...)."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        store, at = pafs.FileSystem.from_uri(self.options["path"])
        store.create_dir(at)
        width, body, index, table, box = int(self.options.get("idWidth", self.options.get("idwidth", 16))), bytearray(), [], bytearray(), None
        for row in iterator:
            points = [(p["x"], p["y"]) for r in row["rings"] for p in r]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            own = (min(xs), min(ys), max(xs), max(ys))
            box = own if box is None else (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
            starts = np.cumsum([0, *(len(r) for r in row["rings"])])[:-1].tolist()
            content = struct.pack("<i4dii", 5, *own, len(starts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + np.array(points, "<f8").tobytes()
            index.append((50 + len(body) // 2, len(content) // 2))
            body += struct.pack(">ii", len(index), len(content) // 2) + content
            table += b" " + str(row["id"]).encode()[:width].ljust(width)
        if index:
            base = f"{at}/part-{uuid.uuid4().hex}"
            head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii4d4d", 1000, 5, *box, 0, 0, 0, 0)
            files = {
                "shp": head(100 + len(body)) + bytes(body),
                "shx": head(100 + 8 * len(index)) + np.array(index, ">i4").tobytes(),
                "dbf": struct.pack("<B3BIHH", 3, 24, 1, 1, len(index), 65, width + 1) + b"\0" * 20 + b"GEOID".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 + b"\r" + bytes(table),
            }
            for kind in ("dbf", "shx", "shp"):  # the shapes last: a file without them isn't read
                with store.open_output_stream(f"{base}.{kind}") as f:
                    f.write(files[kind])
        return WriterCommitMessage()


# --- sheets ----------------------------------------------------------------------------------------------------------------


class SheetRows(DataSource):
    @classmethod
    def name(cls):
        return "sheet_rows"

    def schema(self):
        return "file string, row int, values map<string,string>"

    def reader(self, schema):
        return _SheetReader(self.options)

    def writer(self, schema, overwrite):
        return _SheetWriter(self.options)


def _rows(z: zipfile.ZipFile, sheet: int) -> Iterator[ElementTree.Element]:
    with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_NS}row":
                yield e
                e.clear()


#: The end of a row, and what may hold such signs as plain text.
_ROW_END = re.compile(rb"</(?:[\w.-]+:)?row\s*>|<(?:[\w.-]+:)?row(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S)


class _Past:
    """The bytes of a sheet without the rows from its second on, as many as skip; these are found by their ends, not parsed."""

    def __init__(self, f, skip: int):
        self.f, self.held = f, f.read(4096)
        # In two bytes a sign the ends look otherwise: such a sheet is parsed whole.
        self.skip = 0 if b"\0" in self.held else skip
        self.left = self.skip + 1 if self.skip else 0

    def read(self, size: int = -1) -> bytes:
        while self.left:
            out, at, first = b"", 0, self.left == self.skip + 1
            for m in _ROW_END.finditer(self.held):
                if m[0][:2] == b"<!":
                    if not m[0].endswith(b"-->" if m[0][:4] == b"<!--" else b"]]>"):  # goes on in the next bytes
                        break
                    continue
                self.left, at = self.left - 1, m.end()
                if first:
                    out, first = self.held[:at], False
                if not self.left:
                    break
            if self.left:
                more = self.f.read(1 << 20)
                self.left *= bool(more)  # of a sheet of fewer rows only what closes it is left
                self.held = self.held[at:] + more
            else:
                self.held = self.held[at:]
            if out:
                return out
        out, self.held = self.held, b""
        return out or self.f.read(size)


def _rows_from(z: zipfile.ZipFile, sheet: int, first: int) -> Iterator[tuple[int, ElementTree.Element]]:
    """The first row of a sheet, and those from row first below it on, each with its number from 0."""
    with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
        past, i = _Past(f, first), 0
        for _, e in ElementTree.iterparse(past):
            if e.tag == f"{_NS}row":
                yield i, e
                i += 1 + past.skip * (i == 0)
                e.clear()


def _length(z: zipfile.ZipFile, sheet: int) -> int:
    """Rows below the first that a sheet says it has, ahead of them; counted where it doesn't say."""
    with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
        said = re.search(rb"<(?:\w+:)?dimension\s[^>]*?ref=[\"'][A-Z]+\d+:[A-Z]+(\d+)[\"']", f.read(1 << 16))
    return max(0, int(said[1]) - 1) if said else sum(1 for _ in _rows(z, sheet)) - 1


class _SheetReader(_Filtered):
    takes = ("row",)

    def partitions(self):
        store, names = _files(self.options["path"], ".xlsx")
        most, sheet, out = int(self.options.get("blockRows", self.options.get("blockrows", BLOCK_ROWS))), int(self.options.get("sheet", 1)), []
        for name in names:
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                n = _length(z, sheet)
            step = max(most, -(-n // SHEET_BLOCKS))
            # What a sheet says may be short of its rows: the last block goes on to the end.
            out += [Block(name, at, at + step if at + step < n else sys.maxsize) for at in range(0, max(n, 1), step)]
        return out or [Block("", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        store, _ = _files(self.options["path"], ".xlsx")
        with store.open_input_file(partition.file) as f, zipfile.ZipFile(f) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
            head: dict[int, str | None] = {}
            for i, row in _rows_from(z, int(self.options.get("sheet", 1)), partition.first):
                if i > partition.stop:
                    return
                if i and (i <= partition.first or not self.passes(row=i - 1)):
                    continue
                cells = {}
                for k, cell in enumerate(row.iter(f"{_NS}c")):
                    value = cell.find(f"{_NS}v")
                    at = _column(cell.get("r")) if cell.get("r") else k
                    if cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                if i:
                    yield (partition.file, i - 1, {head[at]: v for at, v in cells.items() if head.get(at) is not None})
                else:
                    head = cells


def _letters(n: int) -> str:
    """The name of the n-th column, from 1."""
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


class _SheetWriter(DataSourceWriter):
    """Workbooks of one sheet, of rows (values: map of texts)."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        from xml.sax.saxutils import escape

        store, at = pafs.FileSystem.from_uri(self.options["path"])
        store.create_dir(at)
        cell = lambda v: '<c t="inlineStr"><is><t>' + escape(v) + "</t></is></c>" if v is not None else "<c/>"
        values = (dict(r["values"]) for r in iterator)
        while rows := list(itertools.islice(values, SHEET_ROWS)):
            names = sorted({k for r in rows for k in r})
            lines = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [names, *([r.get(k) for k in names] for r in rows)])
            with store.open_output_stream(f"{at}/part-{uuid.uuid4().hex}.xlsx") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS[1:-1]}"><dimension ref="A1:{_letters(max(len(names), 1))}{len(rows) + 1}"/><sheetData>{lines}</sheetData></worksheet>')
        return WriterCommitMessage()


# --- rasters ---------------------------------------------------------------------------------------------------------------


class GridTiles(DataSource):
    @classmethod
    def name(cls):
        return "grid_tiles"

    def schema(self):
        return "file string, ix int, iy int, x double, y double, value float"

    def reader(self, schema):
        return _TileReader(self.options)

    def writer(self, schema, overwrite):
        return _TileWriter(self.options)


class _TileReader(_Filtered):
    takes = ("ix", "iy")

    def _head(self, store, name: str) -> dict[str, float]:
        return {k.lower(): float(v) for k, v in (line.split() for line in store.open_input_file(name[:-4] + ".hdr").read().decode().splitlines() if line.strip())}

    def partitions(self):
        store, names = _files(self.options["path"], ".flt")
        most, out = int(self.options.get("blockRows", self.options.get("blockrows", 256))), []
        for name in names:
            n = int(self._head(store, name)["nrows"])
            out += [Block(name, at, min(n, at + most)) for at in range(0, n, most)]
        return out or [Block("", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        store, _ = _files(self.options["path"], ".flt")
        h = self._head(store, partition.file)
        n, width, side = int(h["nrows"]), int(h["ncols"]), h["cellsize"]
        # The file begins with the northern row; iy counts from the corner, over all tiles.
        left, low = round(h["xllcorner"] / side), round(h["yllcorner"] / side)
        lines = [k for k in range(partition.first, partition.stop) if self.passes(iy=low + n - 1 - k)]
        if lines:
            with store.open_input_file(partition.file) as f:
                f.seek(4 * width * lines[0])
                values = np.frombuffer(f.read(4 * width * (lines[-1] + 1 - lines[0])), "<f4").reshape(-1, width)
            for k in lines:
                iy = low + n - 1 - k
                for i, v in enumerate(values[k - lines[0]].tolist()):
                    if v != h["nodata_value"] and self.passes(ix=left + i):
                        yield (partition.file, left + i, iy, (left + i + 0.5) * side, (iy + 0.5) * side, v)


class _TileWriter(DataSourceWriter):
    """A tile a task, of rows (ix, iy, value); cells without a row have no data."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        store, at = pafs.FileSystem.from_uri(self.options["path"])
        store.create_dir(at)
        rows, side = [(r["ix"], r["iy"], r["value"]) for r in iterator], float(self.options.get("cellSize", self.options.get("cellsize", 1)))
        if rows:
            x0, x1, y0, y1 = min(r[0] for r in rows), max(r[0] for r in rows), min(r[1] for r in rows), max(r[1] for r in rows)
            grid = np.full((y1 - y0 + 1, x1 - x0 + 1), -9999, "<f4")
            for x, y, v in rows:
                grid[y1 - y, x - x0] = v
            base = f"{at}/part-{uuid.uuid4().hex}"
            for kind, content in (("hdr", f"ncols {grid.shape[1]}\nnrows {grid.shape[0]}\nxllcorner {x0 * side!r}\nyllcorner {y0 * side!r}\ncellsize {side!r}\nNODATA_value -9999\n".encode()), ("flt", grid.tobytes())):
                with store.open_output_stream(f"{base}.{kind}") as f:
                    f.write(content)
        return WriterCommitMessage()
