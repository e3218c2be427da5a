"""Compare a Spark result with DuckDB's."""

from __future__ import annotations

import os

import duckdb
import numpy as np


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con.execute(sql).df()


def same(a, b) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    k = sorted(a.columns)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    for c in k:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, rtol=1e-9, atol=1e-12), c
        else:
            x, y = (s.astype(object).where(s.notna(), "~").astype(str) for s in (a[c], b[c]))
            assert (x == y).all(), (c, x[x != y].head(3).tolist(), y[x != y].head(3).tolist())
