"""Run queries beside their SQL twins and report differences.

    python -m tests.compare [sf] [name ...]
"""

from __future__ import annotations

import datetime
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith(("Int", "UInt")):  # whole numbers with NULLs, as Spark hands them over
            df[c] = df[c].astype("float64" if df[c].isna().any() else "int64")
        if df[c].map(lambda v: type(v) is datetime.date).any():
            df[c] = pd.to_datetime(df[c])
        if df[c].dtype == object:
            df[c] = df[c].map(
                lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v))
                else (str(list(v)) if isinstance(v, (np.ndarray, list)) else str(v))
            )
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    kinds = {
        c: (got[c].dtype, want[c].dtype)
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind
    }
    if kinds and len(got):
        return f"types {kinds}"
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = np.flatnonzero(~same.to_numpy())
            return f"{len(i)} of {len(a)} differ in {c}: {a.iloc[i[0]]!r} != {b.iloc[i[0]]!r}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from barloom.session import local_session

    sf = argv[0] if argv else "0.01"
    root = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, root).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"ROWS {name} {len(got)} rows {took:.1f}s", flush=True)
                bad += not len(got)
                continue
            start = time.time()
            want = con.execute(sql).df()
            problem = differences(got, want)
            state = "ok  " if problem is None and len(got) else "FAIL"
            print(f"{state} {name} {len(got)} rows {took:.1f}s sql {time.time() - start:.1f}s "
                  f"{problem or ''}", flush=True)
            bad += state == "FAIL"
        except Exception as e:
            bad += 1
            print(f"ERR  {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"{bad} bad of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
