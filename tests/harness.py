"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v) if not isinstance(v, (int, bool)) else v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    table = df.toArrow()
    got = list(zip(*[table.column(i).to_pylist() for i in range(table.num_columns)])) if table.num_columns else []
    t1 = time.time()
    if sql is None:
        return ("rows", len(got), t1 - t0, 0.0, "")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return ("COLUMNS", len(got), t1 - t0, t2 - t1, f"{df.columns} vs {cols}")
    a, b = canon(df.columns, got), canon(cols, want)
    if len(a) != len(b):
        return ("COUNT", len(got), t1 - t0, t2 - t1, f"{len(a)} vs {len(b)}: {a[:2]} {b[:2]}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return ("VALUES", len(got), t1 - t0, t2 - t1, f"{len(bad)} differ: {bad[:3]}")
    return ("ok", len(got), t1 - t0, t2 - t1, "")


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from seqloom.session import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    total = 0.0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            status, n, ts, td, msg = compare(spark, con, folder, name, fn, oracles.get(name))
            total += ts
        except Exception as e:  # report and go on
            status, n, ts, td, msg = "ERROR", 0, 0, 0, str(e)[:900]
        print(f"{status:8} {name:32} rows={n} spark={ts:.2f}s duckdb={td:.2f}s {msg}", flush=True)
    print(f"total spark {total:.1f}s")


if __name__ == "__main__":
    main()
