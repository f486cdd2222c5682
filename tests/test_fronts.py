"""Distances and labels by nested cells against all-pairs relaxation, whatever the size of a task's cells."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from dispatchgrid import catalog
from dispatchgrid.operators import fronts as N
from tests.conftest import DATA
from tests.oracle import same

KINDS = "src long, dst long, km double"


def graph():
    """A map with gaps, long roads, parallel roads, loops, two parts, and nodes at one place."""
    rng = random.Random(11)
    at = {i: (float(i % 9), float(i // 9)) for i in range(81)} | {100 + i: (3.0, 4.0) for i in range(4)} | {200: (50.0, -7.0), 201: (50.0, 60.0)}
    edges = [(9 * i + j, 9 * a + b, rng.randint(10, 19) / 10) for i in range(9) for j in range(9) for a, b in ((i + 1, j), (i, j + 1)) if a < 9 and b < 9 and rng.random() > 0.15]
    edges += [(rng.randrange(81), rng.randrange(81), rng.randint(20, 90) / 10) for _ in range(6)] + [(39, 100, 0.5), (100, 101, 0.5), (101, 102, 0.5), (102, 103, 0.5), (103, 40, 0.5), (200, 201, 3.0), (5, 5, 1.0), (200, 201, 2.0), (201, 200, 2.5)]
    return at, edges


def relaxed(edges):
    nodes = sorted({n for a, b, _ in edges if a != b for n in (a, b)})
    d = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for a, b, km in edges:
        d[a, b] = d[b, a] = min(d[a, b], km) if a != b else 0.0
    for k, a, b in itertools.product(nodes, nodes, nodes):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return nodes, d


@pytest.fixture(params=[1000, 20], ids=["one task", "many tasks"])
def sized(request, monkeypatch):
    monkeypatch.setattr(N, "BASE", request.param)
    monkeypatch.setattr(N, "PART", 4)
    return request.param


def test_distances_from_a_few(spark, sized):
    at, edges = graph()
    nodes, d = relaxed(edges)
    places = spark.createDataFrame([(n, *xy) for n, xy in at.items()], "node long, x double, y double")
    few = [nodes[0], 44, 102, 201]
    e = spark.createDataFrame(edges, KINDS)
    assert (N.nested(e, places)[1] > 1) == (sized == 20)
    got = {(r["src"], r["dst"]): r["km"] for r in N.ways(spark.createDataFrame([(n,) for n in few], "src long"), e, places).collect()}
    assert got == {(a, b): pytest.approx(km) for (a, b), km in d.items() if a in few and km < float("inf")}
    assert N.ways(spark.createDataFrame([], "src long"), e, places).count() == 0


def test_labels(spark, monkeypatch):
    """Hubs have their true distance, two labels give that of any two nodes, and sizes are the same wherever the cells are contracted."""
    monkeypatch.setattr(N, "PART", 1e-15)
    at, edges = graph()
    nodes, d = relaxed(edges)
    places = spark.createDataFrame([(n, *xy) for n, xy in (at | {300: (1.0, 1.0)}).items()], "node long, x double, y double")
    e = spark.createDataFrame(edges, KINDS)
    rows, depth = N.nested(e, places)
    front, ids, _ = N._base(rows.toPandas(), depth, {}, N.PART)
    labels = {}

    def read(f, *known):
        km, up, col = N._hubs(f, *known)
        hub = {**known_as, **dict(zip(col[: f.k].tolist(), ids[f.nodes[: f.k]].tolist(), strict=True))}
        labels.update({int(ids[f.nodes[i]]): {hub[c]: km[i, c] for c in np.flatnonzero(up[i])} for i in range(f.k)})
        for p in f.parts:
            before = dict(known_as)
            known_as.clear()
            known_as.update(hub)
            read(p, km[p.at], up[p.at], col[p.at])
            known_as.clear()
            known_as.update(before)

    known_as: dict[int, int] = {}
    read(front, np.zeros((0, 0)), np.zeros((0, 0), bool), np.zeros(0, int))
    assert depth == 0 and labels.keys() == {*nodes}
    assert all(km == pytest.approx(d[n, h]) for n, own in labels.items() for h, km in own.items())
    for a, b in itertools.product(nodes, nodes):
        met = [labels[a][h] + labels[b][h] for h in labels[a].keys() & labels[b].keys()]
        assert min(met, default=float("inf")) == pytest.approx(d[a, b])
    want = {n: len(own) for n, own in labels.items()} | {300: 1}
    assert sum(want.values()) < len(nodes) ** 2 / 4
    assert {r["node"]: r["hubs"] for r in N.label_sizes(e, places).collect()} == want
    monkeypatch.setattr(N, "BASE", 20)
    assert N.nested(e, places)[1] > 1
    assert {r["node"]: r["hubs"] for r in N.label_sizes(e, places).collect()} == want


def test_a_tree_over_many_tasks(spark, tmp_path, monkeypatch):
    """The path trees of the SQL where the graph takes several rounds of cells."""
    monkeypatch.setattr(N, "BASE", 60)
    for t in ("customer", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    same(catalog.queries()["k5_hub_path_trees"](spark, str(tmp_path)), c.execute(catalog.oracle_sql()["k5_hub_path_trees"]))


def test_labels_of_all_customers(spark):
    """Nodes were a quarter of the customers, with gaps."""
    got = catalog.queries()["k1_hub_label_sizes"](spark, DATA).collect()
    assert sum(r["nodes"] for r in got) == spark.read.parquet(f"{DATA}/customer.parquet").count()


def test_a_map_of_all_customers(spark):
    """Nodes were a quarter of the customers, with gaps."""
    got = {r["node"] for r in catalog.queries()["k4_road_map"](spark, DATA).collect()}
    assert got == {r["c_custkey"] for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
