"""Hold a query against its SQL."""

import datetime
import math
from pathlib import Path

import duckdb


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def _rows(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_cell(r[i]) for i in at) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> int:
    """Assert equal columns and rows; returns the number of rows."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    con.sql("set timezone='UTC'")
    out = con.sql(sql)
    cols, want = out.columns, out.fetchall()
    assert sorted(cols) == sorted(df.columns)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    want = _rows(want, cols)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
    return len(got)
