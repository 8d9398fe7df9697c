"""Run registered queries beside their SQL: python -m tests.oracle [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import threading
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


LIMIT = float(os.environ.get("QUERY_LIMIT", "40"))


def connect(sf: str):
    con = duckdb.connect()
    con.sql("SET threads=8")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "").replace("+00:00", "")
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return f"{float(v):.6g}"
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name, query, sql, sf):
    t0 = time.time()
    timer = threading.Timer(LIMIT, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
    timer.start()
    try:
        return _compare(spark, con, name, query, sql, sf, t0)
    finally:
        timer.cancel()


def _compare(spark, con, name, query, sql, sf, t0):
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0, True
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", t1 - t0, t2 - t1, False
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return f"ok {len(a)}", t1 - t0, t2 - t1, True
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"DIFF {len(a)} vs {len(b)}\n   spark: {only_a}\n   sql:   {only_b}", t1 - t0, t2 - t1, False


def main(argv):
    import __spark_entry__ as entry
    from lexmill.session import build_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf = argv.pop(0)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                          "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        print("..", name, flush=True)
        try:
            msg, ts, td, ok = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            msg, ts, td, ok = f"ERROR {type(exc).__name__} {str(exc)[:600]}", 0, 0, False
        bad += not ok
        print(f"{name:40s} {ts:6.2f}s {td:6.2f}s {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
