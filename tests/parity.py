"""Run registered queries next to their SQL in DuckDB and compare every value.

usage: python tests/parity.py [--sf 0.01] [name prefix ...]
"""
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402
from tickloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def canon(v):
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if type(v).__name__ in ("list", "ndarray", "tuple"):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(spark, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows", took
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return "COLUMNS", f"{sorted(set(df.columns) ^ set(want_cols))}", took
    a, b = rows(df.columns, got), rows(want_cols, want)
    kinds = {c: t for c, t in df.dtypes}
    if a == b:
        return ("ok" if got else "EMPTY"), f"{len(a)} rows", took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    cols = sorted(df.columns)
    note = f"{len(a)} vs {len(b)} rows, {len(bad)} differ"
    if bad:
        x, y = bad[0]
        note += " e.g. " + str([(c, kinds[c], p, q) for c, p, q in zip(cols, x, y) if p != q or c in ("symbol", "exchange", "ts")][:8])
    return "DIFF", note, took


def main():
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = build_session("parity", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, oracle = entry_module.queries(), entry_module.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            status, note, took = compare(spark, f"/root/testdata/sf{sf}", name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            status, note, took = "ERROR", str(e)[:700], 0.0
        if status not in ("ok", "rows"):
            fails += 1
        if status not in ("ok", "rows") or took > 6:
            print(f"{status:8s} {name:34s} {took:5.1f}s {note}", flush=True)
    print(f"failures: {fails}")


if __name__ == "__main__":
    main()
