"""Compare a Spark result with DuckDB's, order and column order aside."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float) and v.is_integer():  # whole numbers of a column with nulls
            return int(v)
        if isinstance(v, (bool, int, str)):
            return v
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return float(v) if hasattr(v, "__float__") else str(v)

    return sorted(repr(tuple(map(plain, r))) for r in df.astype(object).values.tolist())


def same(spark_df, relation):
    a, b = spark_df.toPandas(), relation.fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
