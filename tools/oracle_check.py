"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Row count, sorted column names and an order-insensitive multiset of rounded
values must agree.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from cinder.sources.tables import TABLES  # noqa: E402


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(sql).fetch_df()


def _norm_val(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, (str, bytes, list, tuple, dict)) and pd.isna(v)):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm_val(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm_val(x) for x in v.tolist())
    return str(v)


def normalise(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm_val(r[c]) for c in cols) for r in pdf.to_dict("records")]
    rows.sort(key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return cols, rows


def compare(spark_pdf, duck_pdf):
    sc, sr = normalise(spark_pdf)
    dc, dr = normalise(duck_pdf)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duck={len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{len(sr)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from cinder.plans.catalog import ORACLE, QUERIES
    from cinder.session import build_session
    spark = build_session("local[8]", 8)
    names = names or sorted(QUERIES)
    ok_all = True
    for n in names:
        t0 = time.time()
        try:
            sdf = QUERIES[n](spark, sf_dir)
            spdf = sdf.toPandas()
            t1 = time.time()
            if n not in ORACLE:
                print(f"[rows] {n}: {len(spdf)} rows ({t1 - t0:.1f}s)", flush=True)
                continue
            dpdf = duck(ORACLE[n], sf_dir)
            ok, msg = compare(spdf, dpdf)
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        ok_all &= ok
        print(f"[{'ok' if ok else 'FAIL'}] {n}: {msg} ({time.time() - t0:.1f}s)", flush=True)
    return 0 if ok_all else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
