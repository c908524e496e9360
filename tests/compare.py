"""Compare registered queries with their SQL in DuckDB: python -m tests.compare [names...]."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
import traceback

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        if os.environ.get("STRICT"):
            return f"{f:.12g}"
        return f"{f:.6g}" if abs(f) < 1e-4 and f else f"{f:.5f}".rstrip("0").rstrip(".") if f else "0"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, name, fn, sql, con, sf: str = SF):
    """Return (rows, message); an empty message means equal, None SQL means rows only."""
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), "" if got else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(cols)}"
    if not got and not want:
        return 0, "both empty"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return len(got), ""
    left = [x for x in a if x not in set(b)][:3]
    right = [x for x in b if x not in set(a)][:3]
    return len(got), (f"rows {len(a)} vs {len(b)}; columns {sorted(cols)}\n   spark {left}\n"
                      f"   sql   {right}")


def main(names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from fiscalarc.session import build_session

    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    con, bad = connect(), 0
    names = [n for n in queries if not names or n in names or any(
        n.startswith(p[:-1]) for p in names if p.endswith("*"))]
    for name in names:
        start = time.time()
        try:
            n, msg = check(spark, name, queries[name], oracle.get(name), con)
        except Exception as e:
            n, msg = -1, "".join(traceback.format_exception_only(e))[:1500]
            if "JVM stacktrace" in msg:
                msg = msg.split("JVM stacktrace")[0]
        bad += bool(msg)
        tag = "FAIL" if msg else ("ok" if name in oracle else "ok(rows)")
        if msg or os.environ.get("V"):
            print(f"{tag:8} {name:28} {n:7} rows {time.time() - start:5.1f}s {msg}", flush=True)
    print(f"{len(names)} checked, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
