"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive value multiset.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb
    from tallyspark.session import TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, sf_dir, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    q, o = queries()[name], oracle_sql().get(name)
    t0 = time.time()
    df = q(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if o is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    cur = con.execute(o)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2),
           "cols_ok": sorted(scols) == sorted(dcols)}
    a, b = canon(scols, srows), canon(dcols, drows)
    res["ok"] = res["cols_ok"] and a == b
    if not res["ok"] and verbose:
        print("  spark cols:", sorted(scols))
        print("  duck  cols:", sorted(dcols))
        sa, sb = set(a), set(b)
        print("  only spark:", list(sa - sb)[:3])
        print("  only duck :", list(sb - sa)[:3])
    return res


def main():
    from tallyspark.session import build_session
    from __spark_entry__ import queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "error": repr(e)[:400]}
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED", bad, "of", len(names))


if __name__ == "__main__":
    main()
