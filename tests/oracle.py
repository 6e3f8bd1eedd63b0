"""Run registered queries beside their SQL and compare the rows.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v)) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat(" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return v


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    from topicloom.registry import all_queries, all_sql

    queries, oracles = all_queries()[0], all_sql()
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in oracles:
        return bool(got), f"rows only: {len(got)} rows, spark {t1 - t0:.1f}s"
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    types = {d[0]: str(d[1]) for d in cur.description}
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [f"{n}: {k} / {types.get(n)}" for n, k in df.dtypes if kinds.get(k, k) != types.get(n)]
    note = (f"types differ {odd}; " if odd else "") + f"{len(got)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}; {note}"
    a, b = _rows(df.columns, got), _rows(columns, want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"{sum((a - b).values())} differ of {len(got)}/{len(want)}\n   spark  {only_a}\n   duckdb {only_b}\n   {note}"
    return bool(got), note


def main(argv: list[str]) -> int:
    from topicloom.registry import all_queries
    from topicloom.session import build_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in all_queries()[0]:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + "  " + note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
