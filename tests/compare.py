"""Run registered queries beside their DuckDB text and compare rows as sorted multisets."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "float": "FLOAT", "date": "DATE"}


def check(spark, con, sf_dir, name, fn, sql):
    """(seconds, rows, problem or '')."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return took, len(got), "" if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return took, len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    for f in df.dtypes:
        if KINDS.get(f[1], f[1]) != kinds[f[0]]:
            return took, len(got), f"type of {f[0]}: {f[1]} vs {kinds[f[0]]}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [x for x in a if x not in in_b][:2], [x for x in b if x not in in_a][:2]
        return took, len(got), f"{len(a)} vs {len(b)} rows; spark only {only_a}; oracle only {only_b}"
    return took, len(got), ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from chainloom.session import local_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            took, n, problem = check(spark, con, sf, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            took, n, problem = 0.0, 0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'BAD '} {name:32s} {n:7d} rows {took:6.2f}s {'' if name in oracle else '(rows only)'} {problem}", flush=True)
    print("bad:", bad)
