"""Runs registered queries and their SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.7g}" if v != 0 else "0"
    if isinstance(v, int):
        return f"{float(v):.7g}" if v != 0 else "0"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} rows differ of {len(got)}: {bad[:2]}"
    return f"ok {len(got)}"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from compindex.session import local_session
    from compindex.workload import catalogue

    sf = sys.argv[1]
    names = sys.argv[2:] or list(catalogue.QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in catalogue.ORACLES:
                result = same(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], sf)
            else:
                result = f"ok rows-only {catalogue.QUERIES[name](spark, sf).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        print(f"{name:32s} {time.time() - start:6.1f}s {result}", flush=True)
        if not result.startswith("ok"):
            failed.append(name)
    print("FAILED:", failed)
