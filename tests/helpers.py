"""Comparing a query's rows with those of its SQL."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


def sql(query: str, d: str = DATA) -> pd.DataFrame:
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    return c.execute(query).df()


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
