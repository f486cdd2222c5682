"""Road distances and hub labels of a graph whose nodes have places: nested cells, contracted from the smallest to the whole.

A node stays out of a cell's inside where an edge leads from it to a later cell, so the insides of two cells have no edge between
them. A cell contracts its inside: its front is the matrix of the nodes inside and of those around that they have edges to, each
node inside is taken out by putting the way through it between any two others, and what is left, the ways between the nodes
around, goes on to the cell of four that holds this one. Cells of BASE nodes and their parts are one task each, so there are as
many rounds over tables as the cells of four above them, and a task holds a front: on a map of n nodes about four times the root
of its cell's nodes. On the way back each cell takes what is known of the nodes around it and completes it for its inside:
distances from a few places (`ways`), or the distances to all hubs, of which those that a way upward reaches with no loss are the
node's label (`label_sizes`). A node's hubs are itself and nodes contracted after it; of any two nodes' shortest ways one has its
last contracted node in both labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchgrid.functions.kept import keep

#: Nodes of the cells that a task contracts with their parts, at most, unless they lie at one place; nodes of the smallest parts.
BASE, PART = 32768, 16
#: Halvings of the map's sides that cells go down to; columns of a block of distances.
DEPTH, COLUMNS = 20, 1024
_EPS = 1e-9


@dataclass
class Front:
    """Ways between the nodes (numbers from 0) of a cell: k inside in the order they are contracted, then those around."""

    nodes: np.ndarray
    k: int
    w: np.ndarray
    y: np.ndarray
    parts: list[Front] = field(default_factory=list)
    at: np.ndarray | None = None  # places in the front above of the nodes around


def _front(ends: np.ndarray, km: np.ndarray, inside: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: int, own: dict[int, int]) -> tuple[Front, list[np.ndarray]]:
    """The contracted front of edges (ends: 2 rows of nodes) and what is left of parts (nodes, ways, distances from places); inside:
    of each node whether the cell contracts it; own: places' columns by node."""
    all_ = np.unique(np.concatenate([ends.ravel(), *(p[0] for p in parts)]))
    order = np.argsort(~inside[all_], kind="stable")
    at = np.empty(len(all_), np.int64)
    at[order] = np.arange(len(all_))
    place = lambda n: at[np.searchsorted(all_, n)]
    f, k, nodes = len(all_), int(inside[all_].sum()), all_[order]
    w, y = np.full((f, f), np.inf), np.full((f, columns), np.inf)
    np.fill_diagonal(w, 0.0)
    a, b = place(ends[0]), place(ends[1])
    w[a, b] = w[b, a] = km
    places = []
    for part, ways_, known in parts:
        to = place(part)
        places.append(to)
        w[np.ix_(to, to)] = np.minimum(w[np.ix_(to, to)], ways_)
        y[to] = np.minimum(y[to], known)
    for i in range(k) if own else ():
        if int(nodes[i]) in own:
            y[i, own[int(nodes[i])]] = 0.0
    _contract(w, k, y)
    return Front(nodes, k, w, y), places


def _contract(w: np.ndarray, k: int, y: np.ndarray) -> None:
    for i in range(k):
        to = np.flatnonzero(np.isfinite(w[i, i + 1 :])) + i + 1
        km = w[i, to]
        if 4 * len(to) > 3 * (len(w) - i - 1):
            rest, row = w[i + 1 :, i + 1 :], w[i, i + 1 :]
            step = max(1, (1 << 15) // max(len(row), 1))  # rows whose sums stay near the processor
            for r in range(0, len(row), step):
                np.minimum(rest[r : r + step], row[r : r + step, None] + row, out=rest[r : r + step])
        else:
            w[np.ix_(to, to)] = np.minimum(w[np.ix_(to, to)], km[:, None] + km)
        if y.shape[1] and np.isfinite(y[i]).any():
            y[to] = np.minimum(y[to], km[:, None] + y[i])


def _base(e: pd.DataFrame, depth: int, own: dict[int, int], part: float) -> tuple[Front | None, np.ndarray, np.ndarray]:
    """The front of a cell from its edges, contracted through its parts down to part nodes; ids and depths of the nodes by number."""
    ids, number = np.unique(np.concatenate([e["src"].to_numpy(), e["dst"].to_numpy()]), return_inverse=True)
    ends, km, code = number.reshape(2, -1), e["km"].to_numpy(), e["code"].to_numpy()
    deep = np.empty(len(ids), np.int64)
    deep[ends[0]], deep[ends[1]] = e["src_depth"].to_numpy(), e["dst_depth"].to_numpy()
    last = min(DEPTH, depth + max(0, math.ceil(math.log(max(len(ids), 1) / part, 4))))
    level = np.minimum(np.maximum(deep[ends[0]], deep[ends[1]]), last)
    mine = {int(np.searchsorted(ids, s)): c for s, c in own.items() if len(ids) and ids[min(np.searchsorted(ids, s), len(ids) - 1)] == s}
    below: dict[int, list[Front]] = {}
    for d in range(last, depth - 1, -1):
        inside = deep >= d
        rows = np.flatnonzero(level == d)
        cell = code[rows] >> 2 * (DEPTH - d)
        rows, cell = rows[np.argsort(cell, kind="stable")], np.sort(cell)
        cut = np.flatnonzero(np.diff(cell)) + 1
        edges = dict(zip(cell[np.r_[0, cut]].tolist() if len(cell) else [], np.split(rows, cut), strict=False))
        here: dict[int, list[Front]] = {}
        for c in sorted({*edges, *below}):
            own_rows, parts = edges.get(c, rows[:0]), below.get(c, [])
            front, places = _front(ends[:, own_rows], km[own_rows], inside, [(p.nodes[p.k :], p.w[p.k :, p.k :], p.y[p.k :]) for p in parts], len(own), mine)
            for p, to in zip(parts, places, strict=True):
                p.at, p.w, p.y = to, p.w[: p.k].copy(), p.y[: p.k].copy()
            front.parts = parts
            here.setdefault(c >> 2 if d > depth else c, []).append(front)
        below = here
    return next(iter(below.values()))[0] if below else None, ids, deep


def _complete(front: Front, known: np.ndarray) -> np.ndarray:
    """Distances from the places to all nodes of a front, from those of the nodes around it."""
    x = np.concatenate([front.y[: front.k], known])
    for i in range(front.k - 1, -1, -1):
        x[i] = np.minimum(x[i], (front.w[i, i + 1 :, None] + x[i + 1 :]).min(0, initial=np.inf))
    return x


def _completed(front: Front, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    x = _complete(front, known)
    yield front.nodes[: front.k], x[: front.k]
    for p in front.parts:
        yield from _completed(p, x[p.at])


def _hubs(front: Front, d: np.ndarray, up: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances to all hubs, whether a way upward has them, and the nodes' own columns, for all nodes of a front, from those of the
    nodes around it; the nodes inside become columns after the others."""
    k, f, n = front.k, len(front.nodes), d.shape[1] + front.k
    near, held = np.full((f, f), np.inf), np.zeros((f, f), bool)  # of the front's nodes alone
    near[k:, k:], held[k:, k:] = d[:, col], up[:, col]
    np.fill_diagonal(held, False)
    d = np.pad(d, ((k, 0), (0, k)), constant_values=np.inf)
    up = np.pad(up, ((k, 0), (0, k)))
    col = np.concatenate([np.arange(n - k, n), col])
    for i in range(k - 1, -1, -1):
        to = np.flatnonzero(np.isfinite(front.w[i, i + 1 :])) + i + 1
        km = front.w[i, to]
        # A way that is longer than another, or one upward through a node between, adds nothing.
        least, between = np.full(len(to), np.inf), np.zeros(len(to), bool)
        step = max(1, (1 << 16) // max(len(to), 1))
        for r in range(0, len(to), step):
            at = (slice(to[r], to[r] + step), slice(i + 1, None)) if len(to) == f - i - 1 else np.ix_(to[r : r + step], to)
            via = near[at] + km[r : r + step, None]
            np.minimum(least, via.min(0), out=least)
            between |= ((via <= km + _EPS) & held[at]).any(0)
        needed = (km <= least + _EPS) & ~between
        to, km = to[needed], km[needed]
        for c in range(0, n if len(to) else 0, COLUMNS):
            s = d[to, c : c + COLUMNS]
            s += km[:, None]
            d[i, c : c + COLUMNS] = s.min(0)
            up[i, c : c + COLUMNS] = ((s <= d[i, c : c + COLUMNS] + _EPS) & up[to, c : c + COLUMNS]).any(0)
        d[i, col[i]], up[i, col[i]] = 0.0, True
        near[i, i + 1 :] = near[i + 1 :, i] = d[i + 1 :, col[i]] = d[i, col[i + 1 :]]
        held[i, i + 1 :] = up[i, col[i + 1 :]]
    return d, up, col


def _sizes(front: Front, d: np.ndarray, up: np.ndarray, col: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    d, up, col = _hubs(front, d, up, col)
    yield front.nodes[: front.k], up[: front.k].sum(1)
    for p in front.parts:
        yield from _sizes(p, d[p.at], up[p.at], col[p.at])


# --- over tables -----------------------------------------------------------------------------------------------------------


def _spread(c: Column) -> Column:
    """The bits of a number below 2**20 with a gap after each."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
    return c


def _cell(depth: Column | int, code: str = "code") -> Column:
    return F.expr(f"shiftright({code}, {2 * (DEPTH - depth)})") if isinstance(depth, int) else F.expr(f"shiftright({code}, 2 * ({DEPTH} - depth))")


def nested(edges: DataFrame, places: DataFrame) -> tuple[DataFrame, int]:
    """Undirected edges (src, dst, km; either direction or both, lengths above 0) with the cells that contract them, from places
    (node, x, y) of all nodes; and the depth of the cells that are a task."""
    box = places.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    scale = ((1 << DEPTH) - 1) / max((box["x1"] or 0) - (box["x"] or 0), (box["y1"] or 0) - (box["y"] or 0), 1e-9)
    step = lambda c: F.floor((F.col(c) - (box[c] or 0)) * scale).cast("long")
    coded = keep(places.select("node", _spread(step("x")).bitwiseOR(F.shiftleft(_spread(step("y")), 1)).alias("code")), "codes")
    depth = max(0, math.ceil(math.log(max(box["n"], 1) / BASE, 4)))
    while depth < DEPTH and coded.groupBy(_cell(depth)).count().agg(F.max("count").alias("n")).first()["n"] > BASE:
        depth += 1
    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("km").alias("km"))
    at = lambda end: coded.select(F.col("node").alias(end), F.col("code").alias(f"{end}_code"))
    one = keep(one.join(at("src"), "src").join(at("dst"), "dst"), "roads")
    # A node is inside a cell as long as no edge leads to a later one: as deep as its code agrees with the latest of its neighbours.
    met = one.select(F.col("src").alias("node"), F.col("src_code").alias("code"), F.col("dst_code").alias("other")).unionByName(one.select(F.col("dst").alias("node"), F.col("dst_code").alias("code"), F.col("src_code").alias("other")))
    differ = F.col("code").bitwiseXOR(F.max(F.greatest("code", "other")))
    deep = met.groupBy("node", "code").agg((DEPTH - F.when(differ == 0, 0).otherwise(F.ceil(F.length(F.bin(differ)) / 2))).cast("int").alias("deep")).drop("code")
    own = lambda end: deep.select(F.col("node").alias(end), F.col("deep").alias(f"{end}_depth"))
    one = one.join(own("src"), "src").join(own("dst"), "dst")
    one = one.select("src", "dst", "km", "src_depth", "dst_depth", F.least(F.greatest("src_depth", "dst_depth"), F.lit(depth)).alias("depth"), F.when(F.col("src_depth") >= F.col("dst_depth"), F.col("src_code")).otherwise(F.col("dst_code")).alias("code"))
    return keep(one.withColumn("cell", _cell(F.col("depth"))), "nested"), depth


_ROWS = "cell long, at int, k int, node long, depth int, w array<double>, y array<double>"


def _rows(cell: int, front: Front, ids: np.ndarray, deep: np.ndarray, first: int = 0) -> pd.DataFrame:
    """Nodes of a front from the first on, with their ways: of those inside to all, of those around to each other."""
    n, k = range(first, len(front.nodes)), front.k
    return pd.DataFrame({"cell": cell, "at": list(n), "k": k, "node": ids[front.nodes[first:]], "depth": deep[front.nodes[first:]], "w": [front.w[i] if i < k else front.w[i, k:] for i in n], "y": [front.y[i] for i in n]})


def _read(rows: pd.DataFrame) -> Front:
    rows = rows.sort_values("at")
    k = int(rows["k"].iloc[0])
    w = np.stack(rows["w"].iloc[:k]) if k else np.zeros((0, len(rows)))
    y = np.stack(rows["y"].iloc[:k]) if k else np.zeros((0, len(rows["y"].iloc[0])))
    return Front(rows["node"].to_numpy(), k, w, y)


def _dealt(df: DataFrame, depth: int, by: str = "cell") -> DataFrame:
    return df.repartition(min(4**depth, 4096), by)


def contracted(edges: DataFrame, depth: int, own: dict[int, int]) -> list[DataFrame]:
    """Fronts' rows by depth: of all nodes above the tasks' depth, and there of the nodes around the cells alone."""

    def base(e: pd.DataFrame) -> pd.DataFrame:
        front, ids, deep = _base(e, depth, own, PART)
        return _rows(int(e["cell"].iloc[0]), front, ids, deep, front.k)

    if not depth:  # the one cell there is has no nodes around it
        return [edges.sparkSession.createDataFrame([], _ROWS)]
    fronts = [keep(_dealt(edges.where(F.col("depth") == depth), depth).groupBy("cell").applyInPandas(base, _ROWS), "fronts")]
    for d in range(depth - 1, -1, -1):
        depth_of = d

        def join(key: tuple, e: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            ids, number = np.unique(np.concatenate([e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)]), return_inverse=True)
            deep = np.empty(len(ids), np.int64)
            deep[number] = np.concatenate([e["src_depth"], e["dst_depth"], rows["depth"]])
            parts = [p.sort_values("at") for _, p in rows.groupby("part")]
            parts = [(np.searchsorted(ids, p["node"].to_numpy()), np.stack(p["w"]), np.stack(p["y"])) for p in parts]
            front, _ = _front(number[: 2 * len(e)].reshape(2, -1), e["km"].to_numpy(), deep >= depth_of, parts, len(own), {int(np.searchsorted(ids, s)): c for s, c in own.items() if s in ids})
            return _rows(key[0], front, ids, deep)

        left = fronts[0].where(F.col("at") >= F.col("k")).select(F.expr("shiftright(cell, 2)").alias("cell"), F.col("cell").alias("part"), "at", "node", "depth", "w", "y")
        here = _dealt(edges.where(F.col("depth") == d).select("cell", "src", "dst", "km", "src_depth", "dst_depth"), d)
        fronts.insert(0, keep(here.groupBy("cell").cogroup(_dealt(left, d).groupBy("cell")).applyInPandas(join, _ROWS), "fronts"))
    return fronts


def _around(fronts: DataFrame, above: DataFrame, *columns: str) -> DataFrame:
    """The nodes around cells with what the front above knows of them."""
    around = fronts.where(F.col("at") >= F.col("k")).select("cell", F.expr("shiftright(cell, 2)").alias("upper"), "at", "node")
    around = around.join(above.select(F.col("cell").alias("upper"), "node", *columns), ["upper", "node"])
    return around.select(*(F.col(c).alias(c) for c in ("cell", "at", *columns)))


def _nothing_above(fronts: DataFrame, kinds: str) -> DataFrame:
    return fronts.sparkSession.createDataFrame([], f"cell long, node long, {kinds}")


def ways(from_: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """src, dst, km from a few places (src) to all nodes that a way connects; edges and places as of `nested`."""
    names = sorted(r["src"] for r in from_.select("src").distinct().collect())
    own = {n: i for i, n in enumerate(names)}
    e, depth = nested(edges, places)
    fronts, out = contracted(e, depth, own), []
    above = _nothing_above(e, "x array<double>")
    known = lambda b: np.stack(b.sort_values("at")["x"]) if len(b) else np.zeros((0, len(own)))

    def complete(key: tuple, rows: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        front = _read(rows)
        return pd.DataFrame({"cell": key[0], "node": front.nodes, "inside": np.arange(len(front.nodes)) < front.k, "x": list(_complete(front, known(b)))})

    def base(key: tuple, edges: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        front, ids, _ = _base(edges, depth, own, PART)
        parts = list(_completed(front, known(b)))
        return pd.DataFrame({"cell": key[0], "node": ids[np.concatenate([p[0] for p in parts])], "inside": True, "x": list(np.concatenate([p[1] for p in parts]))})

    for d in range(depth + 1):
        b = _dealt(_around(fronts[d], above, "x"), d).groupBy("cell")
        here, run = (fronts[d], complete) if d < depth else (e.where(F.col("depth") == depth), base)
        above = keep(_dealt(here, d).groupBy("cell").cogroup(b).applyInPandas(run, "cell long, node long, inside boolean, x array<double>"), "ways")
        out.append(above.where("inside"))
    x = out[0]
    for o in out[1:]:
        x = x.unionByName(o)
    kind = edges.schema["src"].dataType
    name = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<long>")
    return x.select("node", F.posexplode("x").alias("i", "km")).where(F.col("km") < float("inf")).select(F.get(name, F.col("i")).cast(kind).alias("src"), F.col("node").cast(kind).alias("dst"), "km")


def label_sizes(edges: DataFrame, places: DataFrame) -> DataFrame:
    """node, hubs: how many hubs each node has; places without an edge are their own."""
    e, depth = nested(edges, places)
    fronts, out = contracted(e, depth, {}), []
    above = _nothing_above(e, "d array<double>, up binary, col int")
    def known(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = b.sort_values("at")
        if not len(b):
            return np.zeros((0, 0)), np.zeros((0, 0), bool), np.zeros(0, np.int64)
        dist = np.stack(b["d"])
        return dist, np.stack([np.unpackbits(np.frombuffer(u, np.uint8), count=dist.shape[1]) for u in b["up"]]).astype(bool), b["col"].to_numpy(np.int64)

    def complete(key: tuple, rows: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        front = _read(rows)
        dist, up, col = _hubs(front, *known(b))
        hubs = np.where(np.arange(len(dist)) < front.k, up.sum(1), 0)
        return pd.DataFrame({"cell": key[0], "node": front.nodes, "hubs": hubs, "d": list(dist), "up": [np.packbits(u).tobytes() for u in up], "col": col})

    def base(key: tuple, edges: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        front, ids, _ = _base(edges, depth, {}, PART)
        parts = list(_sizes(front, *known(b)))
        return pd.DataFrame({"node": ids[np.concatenate([p[0] for p in parts])], "hubs": np.concatenate([p[1] for p in parts])})

    for d in range(depth + 1):
        b = _dealt(_around(fronts[d], above, "d", "up", "col"), d).groupBy("cell")
        if d == depth:
            out.append(_dealt(e.where(F.col("depth") == depth), d).groupBy("cell").cogroup(b).applyInPandas(base, "node long, hubs long"))
        else:
            above = keep(_dealt(fronts[d], d).groupBy("cell").cogroup(b).applyInPandas(complete, "cell long, node long, hubs long, d array<double>, up binary, col int"), "hubs")
            out.append(above.where("hubs > 0").select("node", "hubs"))
    x = out[0]
    for o in out[1:]:
        x = x.unionByName(o)
    met = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return x.unionByName(places.select(F.col("node").cast("long").alias("node")).join(met, "node", "left_anti").distinct().select("node", F.lit(1).cast("long").alias("hubs")))
