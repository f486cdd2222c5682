import numpy as np
import pytest
from pyspark.sql import functions as F

from dispatchgrid.functions import medians


@pytest.mark.parametrize("left", [3, 50_000])
def test_medians_equal_numpy(spark, monkeypatch, left):
    monkeypatch.setattr(medians, "LEFT", left)
    monkeypatch.setattr(medians, "BINS", 4)
    rng = np.random.default_rng(3)
    groups = {"a": rng.lognormal(0, 4, 401), "b": rng.integers(0, 3, 300).astype(float), "c": np.full(50, 7.0), "d": np.array([1.0, 4.0]), "e": -rng.random(99) ** 5, "f": np.array([2.5])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("g", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r["key"]: r["median"] for r in medians.exact_medians(df, F.col("x"), F.col("g")).collect()}
    assert got == {k: pytest.approx(float(np.median(v)), rel=1e-15) for k, v in groups.items()}
    assert medians.exact_medians(df.where("g = 'a'"), F.col("x")).first()["median"] == pytest.approx(float(np.median(groups["a"])), rel=1e-15)
    assert medians.exact_medians(df.limit(0), F.col("x")).count() == 0
