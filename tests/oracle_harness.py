"""Run registered queries on Spark and their oracle SQL on DuckDB; compare like the driver.

usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) if abs(v) < 1e6 else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v) if not isinstance(v, (int, bool, str)) else v


def canon(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:400])
            continue
        dt = time.time() - t0
        if name not in orc:
            results[name] = ("ROWS_ONLY", f"{len(sp)} rows {dt:.1f}s")
            continue
        try:
            dk = con.sql(orc[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = ("ORACLE_ERROR", repr(e)[:400])
            continue
        c1, r1 = canon(sp)
        c2, r2 = canon(dk)
        if c1 != c2:
            results[name] = ("COLS", f"spark={c1} oracle={c2}")
        elif len(r1) != len(r2):
            results[name] = ("ROWCOUNT", f"spark={len(r1)} oracle={len(r2)}")
        elif r1 != r2:
            bad = [(a, b) for a, b in zip(r1, r2) if a != b][:2]
            results[name] = ("VALUES", f"{bad}")
        else:
            results[name] = ("OK", f"{len(r1)} rows {dt:.1f}s")
    if verbose:
        for k, (s, m) in results.items():
            print(f"{s:13s} {k:32s} {m}")
    return results


if __name__ == "__main__":
    from quarry.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, (s, _) in res.items() if s not in ("OK", "ROWS_ONLY")]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")
