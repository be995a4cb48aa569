"""Run registered queries beside their SQL on the same tables and report differences.

usage: python check_oracles.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

from offerlens.session import local_session
from offerlens.plans.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None where both frames hold the same rows in the same types, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    if types and len(got):
        return f"types {types}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        x, y = a[c].astype(object).where(a[c].notna(), None), b[c].astype(object).where(b[c].notna(), None)
        bad = [i for i, (p, q) in enumerate(zip(x, y)) if p != q]
        if bad:
            i = bad[0]
            return f"{len(bad)} values of {c}, first: {a.iloc[i].to_dict()} / {b.iloc[i].to_dict()}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session("check")
    con = connect(folder)
    failed = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - t
            if name in ORACLES:
                t = time.time()
                want = con.execute(ORACLES[name]).df()
                problem = difference(got, want)
                note = f"sql {time.time() - t:.1f}s"
            else:
                problem, note = None, "rows only"
        except Exception as exc:  # report and go on with the next query
            traceback.print_exc(limit=-3)
            got, took, problem, note = pd.DataFrame(), time.time() - t, f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(got)} {took:.1f}s {note} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
