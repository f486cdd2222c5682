"""e7 and s6 over whole tables, against loops."""

import pandas as pd

from dispatchgrid import catalog
from tests.conftest import DATA


def test_arrival_times_of_every_trip(spark):
    t = pd.read_parquet(f"{DATA}/lineitem.parquet").sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    t["h"] = (0.01 + t.l_quantity.astype(float) / 600).groupby(t.l_orderkey).cumsum()
    want = sorted(zip(t.l_orderkey % 50, t.l_orderkey, t.l_linenumber, t.h, strict=True))
    got = sorted(map(tuple, catalog.queries()["e7_arrival_times"](spark, DATA).select("vehicle", "trip", "seq", "arrival_h").collect()))
    assert len(got) == len(want) and [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_insertions_of_every_user(spark, tmp_path):
    events = [(i, 7 if i < 250 else i % 3, "purchase" if i % 5 or i < 250 else "click") for i in range(270)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    want = set()
    for user in {u for _, u, kind in events if kind == "purchase"}:
        e = [str(i) for i, u, kind in events if u == user and kind == "purchase"]
        want |= {(user, k, ",".join([*e[:k], "x", *e[k:]])) for k in range(len(e) + 1)}
    got = [tuple(r) for r in catalog.queries()["s6_insertion_positions"](spark, str(tmp_path)).select("user_id", "position", "events").collect()]
    assert set(got) == want and len(got) == len(want)
