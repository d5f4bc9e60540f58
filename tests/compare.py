"""Spark-vs-DuckDB comparison used by the tests and by hand.

Usage: python tests/compare.py [sf_dir] [name ...]
"""
from __future__ import annotations

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
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)


def compare(spark, sf_dir, name, fn, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sc, sr = rows_of_spark(fn(spark, sf_dir))
    t1 = time.time()
    dc, dr = rows_of_duck(con, sql)
    t2 = time.time()
    ok = sc == dc and sr == dr
    info = dict(name=name, ok=ok, spark_rows=len(sr), duck_rows=len(dr), spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sc != dc:
        info["cols"] = (sc, dc)
    elif sr != dr:
        ss, ds = set(sr), set(dr)
        info["only_spark"] = sorted(ss - ds, key=repr)[:3]
        info["only_duck"] = sorted(ds - ss, key=repr)[:3]
    return info


if __name__ == "__main__":
    from sitemill.session import local_session
    from sitemill.plans.catalog import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        if n not in ORACLES:
            df = QUERIES[n](spark, sf_dir)
            print({"name": n, "oracle": None, "rows": df.count()}, flush=True)
            continue
        try:
            info = compare(spark, sf_dir, n, QUERIES[n], ORACLES[n], con)
        except Exception as e:  # report and continue
            info = {"name": n, "ok": False, "error": repr(e)[:2000]}
        bad += not info["ok"]
        print(info, flush=True)
    sys.exit(1 if bad else 0)
