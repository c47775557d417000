"""Run registered queries and their SQL on the same tables and compare the rows."""
from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if v is None else "~" + v for v in t))


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    start = time.time()
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(rows), None, took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(rows), f"columns {sorted(df.columns)} vs {sorted(names)}", took
    got, want = normal(df.columns, rows), normal(names, expected)
    if got == want:
        return len(rows), None, took
    missing = [w for w in want if w not in set(got)][:3]
    extra = [g for g in got if g not in set(want)][:3]
    return len(rows), f"{len(got)} vs {len(want)} rows; only SQL {missing}; only Spark {extra}", took


if __name__ == "__main__":
    from shirube.session import local_session
    from shirube import workload

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sql = workload.all_sql()
    for name, fn in workload.all_queries().items():
        if wanted and name not in wanted:
            continue
        try:
            n, problem, took = compare(spark, con, sf, fn, sql.get(name))
            print(f"{'OK ' if problem is None else 'BAD'} {name:28s} rows={n} {took:.1f}s {problem or ''}"[:900], flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"ERR {name}: {str(error)[:400]}", flush=True)
