"""A Spark result against DuckDB's, rows in any order."""

import glob
import os

import duckdb


def _norm(v):
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.6g}"
    return str(v)


def same(df, sql, sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = df.toPandas(), c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple((x is None, x or "") for x in r)
    rows = [sorted((tuple(_norm(v) for v in r) for r in t[cols].itertuples(index=False)), key=key) for t in (got, want)]
    assert rows[0] == rows[1]
