"""Side-by-side check of a registered Spark query against its DuckDB SQL:
row count, column names and an order-insensitive hash of the values.

Usage: python tests/oracle_harness.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

#: The smallest driver tables, which the tests use.
SMALL = "/root/testdata/sf0.001"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()[:16], keyed


def duck(sf_dir: str, sql: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, show: int = 5) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"query": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["oracle"] = "none"
        return res
    d_cols, d_rows = duck(sf_dir, sql)
    res["duck_rows"] = len(d_rows)
    res["cols_match"] = sorted(s_cols) == sorted(d_cols)
    hs, ks = rows_digest(s_cols, s_rows)
    hd, kd = rows_digest(d_cols, d_rows)
    res["hash_match"] = hs == hd
    if not res["cols_match"]:
        res["spark_cols"], res["duck_cols"] = sorted(s_cols), sorted(d_cols)
    if not res["hash_match"] and res["cols_match"]:
        only_s = sorted(set(ks) - set(kd))[:show]
        only_d = sorted(set(kd) - set(ks))[:show]
        res["only_spark"], res["only_duck"] = only_s, only_d
    return res


def main(argv):
    from shortlist.session import get_session
    import __spark_entry__ as E
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(E.queries())
    spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, qs[n], sqls.get(n))
        except Exception as exc:  # noqa: BLE001
            r = {"query": n, "error": repr(exc)[:2000]}
        ok = r.get("oracle") == "none" or (r.get("cols_match") and r.get("hash_match")
                                           and r.get("spark_rows") == r.get("duck_rows"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")


if __name__ == "__main__":
    main(sys.argv)
