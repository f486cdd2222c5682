"""d35 and h38 over all dimensions, against numpy."""

import numpy as np
import pytest

from dispatchgrid import catalog


def test_all_dimensions(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(20, 64)).astype("float32")
    x[0, 40] = np.nan
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    q = catalog.queries()
    total = {r["vec_id"]: r["total"] for r in q["d35_nansum_vector"](spark, str(tmp_path)).collect()}
    assert total == pytest.approx({i: float(np.nansum(r.astype(float))) for i, r in enumerate(x)}, abs=2e-6)
    label = {r["vec_id"]: r["label"] for r in q["h38_one_hot_argmax"](spark, str(tmp_path)).collect() if r["vec_id"]}
    assert label == {i: int(r.argmax()) + 1 for i, r in enumerate(x) if i} and max(label.values()) > 16
