"""Run registered queries in Spark and their oracle SQL in DuckDB on the same
parquet tables; compare schema names, row counts and sorted values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if hasattr(v, "__float__") and not isinstance(v, (int, bool)):
        return round(float(v), 6)
    return v


def compare(spark, sf_dir: str, name: str, qfn, sql: str | None, con=None):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    cols = sdf.columns
    srows = sdf.collect()
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=True, rows=len(srows), spark_s=round(t1 - t0, 2), oracle=False)
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out = dict(name=name, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2), oracle=True)
    if sorted(cols) != sorted(dcols):
        out.update(ok=False, why=f"columns {cols} vs {dcols}")
        return out
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_norm(r[i]) for i in si) for r in srows), key=key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in drows), key=key)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out.update(ok=False, why=f"values differ, first: {diff}")
        return out
    out["ok"] = True
    return out


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as se
    from amity.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = local_session()
    q, o = se.queries(), se.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in q.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, sf_dir, name, fn, o.get(name), con)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += not r["ok"]
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv)
