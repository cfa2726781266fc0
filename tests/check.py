"""Compare registered queries with their SQL on DuckDB: ``python tests/check.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    return v


def kind(t: str) -> str:
    t = t.lower()
    names = {"string": "varchar", "int": "integer", "long": "bigint"}
    return names.get(t, t)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return took, len(got), None if got else "no rows"
    cur = con.execute(sql)
    desc = {c[0]: str(c[1]) for c in cur.description}
    order = [c[0] for c in cur.description]
    if sorted(order) != cols:
        return took, len(got), f"columns {cols} vs {sorted(order)}"
    raw = cur.fetchall()
    at = [order.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in raw]
    types = [(f.name, kind(f.dataType.simpleString()), kind(desc[f.name])) for f in df.schema]
    odd = [t for t in types if t[1] != t[2]]
    if len(got) != len(want):
        return took, len(got), f"rows {len(got)} vs {len(want)}"
    key = lambda r: tuple((x is not None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in r)
    bad = [(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key)) if a != b]
    if bad:
        return took, len(got), f"{len(bad)} rows differ, e.g. {bad[0]} cols {cols}"
    if odd:
        return took, len(got), f"types {odd}"
    return took, len(got), None


def main(argv):
    from sigframe.session import local_session
    from sigframe.workload import load

    sf_dir, names = argv[0], argv[1:]
    qs, sqls = load()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for n, fn in qs.items():
        if names and not any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names):
            continue
        try:
            took, rows, err = compare(spark, con, n, fn, sqls.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            took, rows, err = 0, 0, f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(err)
        print(f"{'FAIL' if err else 'ok  '} {n:34s} {took:6.2f}s {rows:8d} {'sql' if n in sqls else 'rows'} {err or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
