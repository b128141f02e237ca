"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (datetime.datetime, datetime.date, str, int)):
        return v
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return float(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_result(df):
    return df.columns, [tuple(r) for r in df.collect()]


def sql_result(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def differences(a, b) -> str | None:
    """None if equal, else a short description; floats must agree after the queries' own rounding."""
    (ca, ra), (cb, rb) = a, b
    if sorted(ca) != sorted(cb):
        return f"columns {sorted(ca)} vs {sorted(cb)}"
    if len(ra) != len(rb):
        return f"{len(ra)} rows vs {len(rb)}"
    na, nb = _rows(ca, ra), _rows(cb, rb)
    left, right = Counter(na), Counter(nb)
    only_a, only_b = sorted((left - right).elements(), key=repr), sorted((right - left).elements(), key=repr)
    bad = list(zip(only_a, only_b))
    if bad:
        return f"{len(bad)} of {len(na)} rows differ, columns {sorted(ca)}, first:\n  spark {bad[0][0]}\n  sql   {bad[0][1]}"
    return None


def main(names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from hazeloom.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            got = spark_result(queries[name](spark, folder))
            took = time.time() - start
            verdict = differences(got, sql_result(con, sql[name])) if name in sql else f"rows only: {len(got[1])}"
            ok = verdict is None or name not in sql
            note = f"{len(got[1])} rows" if verdict is None else verdict
        except Exception as e:  # report and go on with the next query
            ok, took, note = False, time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {note}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
