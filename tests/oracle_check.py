"""Run registered queries on Spark and their SQL on DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive hash of the rows
(floats rounded to 6 places, timestamps as naive UTC).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest(), keyed


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    hs, ks = digest(s_cols, s_rows)
    hd, kd = digest(d_cols, d_rows)
    status = "OK" if (ok_cols and len(s_rows) == len(d_rows) and hs == hd) else "MISMATCH"
    print(f"{status:8s} {name:34s} spark={len(s_rows):7d} duck={len(d_rows):7d} {t1 - t0:6.1f}s",
          flush=True)
    if status != "OK":
        if not ok_cols:
            print("   cols spark", s_cols, "\n   cols duck ", d_cols)
        a, b = set(ks), set(kd)
        print("   only spark:", sorted(a - b)[:3])
        print("   only duck :", sorted(b - a)[:3])
    return status == "OK"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from adlens.session import local_session
    import __spark_entry__ as E
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"{'ROWS':8s} {name:34s} spark={n:7d} {'':13s} {time.time() - t0:6.1f}s", flush=True)
            continue
        try:
            if not compare(spark, con, name, fn, sqls[name], sf_dir):
                bad.append(name)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR    {name}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            bad.append(name)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
