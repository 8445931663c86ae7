"""Runs registered queries against DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pandas as pd


def rows_of(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    """Columns by name, and rows as sorted tuples with nulls and floats in one form."""
    names = sorted(frame.columns)

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    rows = [tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False, name=None)]
    return names, sorted(rows, key=repr)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    """Coarse kinds, as nulls turn integers into floats in pandas."""
    return {c: "number" if frame[c].dtype.kind in "iuf" else frame[c].dtype.kind for c in sorted(frame.columns)}


def oracle(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def difference(spark, query, sql: str, sf_dir: str, con) -> str | None:
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    (a, x), (b, y) = rows_of(ours), rows_of(theirs)
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    return next((f"{p} and {q}" for p, q in zip(x, y, strict=True) if p != q), None)


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from docquarry.session import session

    spark = session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle(sys.argv[1]), 0
    for name, sql in entry.oracle_sql().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            found = difference(spark, entry.queries()[name], sql, sys.argv[1], con)
        except Exception as error:  # a tool for the eye: every query gets its line
            found = f"{type(error).__name__}: {str(error)[:500]}"
        bad += found is not None
        print(f"{name}: {'equal' if found is None else found} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bool(bad))
