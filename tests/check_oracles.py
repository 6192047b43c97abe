"""Runs queries on Spark and their SQL in DuckDB on the same tables and compares the rows.

    python tests/check_oracles.py [--sf DIR] [name prefixes...]
"""

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from kinfold.plans.tables import NAMES  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(9) + 0.0
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else v)
    return df.sort_values(list(df.columns), kind="stable", key=lambda s: s.astype(str)).reset_index(drop=True)


def compare(got, want):
    """Empty text if both frames hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    g, w = plain(got), plain(want)
    for c in g.columns:
        if g[c].dtype.kind != w[c].dtype.kind and len(g):
            return f"type of {c}: {g[c].dtype} / {w[c].dtype}"
        same = (g[c] == w[c]) | (g[c].isna() & w[c].isna())
        if g[c].dtype.kind == "f":
            same |= np.isclose(g[c], w[c], rtol=0, atol=1e-9)
        if not same.all():
            i = int(np.flatnonzero(~same)[0])
            return f"{(~same).sum()} values of {c}, first\n  {g.loc[i].to_dict()}\n  {w.loc[i].to_dict()}"
    return ""


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from kinfold.session import local_session

    spark = local_session(8, "check")
    con = connect(args.sf)
    oracles, bad = entry.oracle_sql(), []
    chosen = [q for q in entry.queries() if not args.names or any(q.startswith(n) for n in args.names)]
    for name in chosen:
        start = time.time()
        try:
            got = entry.queries()[name](spark, args.sf).toPandas()
            seconds = time.time() - start
            problem = compare(got, con.execute(oracles[name]).df()) if name in oracles else ""
            if not problem and got.empty:
                problem = "no rows"
        except Exception as e:  # noqa: BLE001
            seconds, got, problem = time.time() - start, [], f"{type(e).__name__}: {str(e)[:600]}"
        checked = "sql" if name in oracles else "rows"
        print(f"{'OK  ' if not problem else 'BAD '} {name} [{checked}] {len(got)} rows {seconds:.1f}s (sql {time.time() - start - seconds:.1f}s) {problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(chosen)} queries, {len(bad)} bad: {' '.join(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
