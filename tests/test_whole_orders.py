"""e3 over all orders, against a loop."""

import pandas as pd

from dispatchgrid import catalog
from tests.conftest import DATA


def test_truncation_of_all_orders(spark):
    o = pd.read_parquet(f"{DATA}/orders.parquet")
    want = {}
    for block, g in o.groupby(o.o_custkey % 25):
        kept = []
        for q in g.sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).o_totalprice:
            if sum(kept) > 1500000:
                break
            kept.append(q)
        want[block] = (len(kept), round(sum(kept), 2))
    got = {r["block"]: (r["kept"], round(r["load"], 2)) for r in catalog.queries()["e3_capacity_truncation"](spark, DATA).collect()}
    assert got == want and got
