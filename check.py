"""Compare registered queries with their SQL counterparts: ``python check.py [sf] [prefix ...]``."""

from __future__ import annotations

import logging
import os
import sys
import time

import duckdb

from tidemark.catalog import load
from tidemark.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = sys.argv[2:]
    base = os.environ.get("TESTDATA", "/root/testdata") + "/" + sf
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    spark.conf.set("spark.sql.pyspark.jvmStacktrace.enabled", "false")
    logging.disable(logging.CRITICAL)
    if os.environ.get("LAYOUT"):
        spark.conf.set("tidemark.layout", os.environ["LAYOUT"])
        spark.conf.set("tidemark.cell.rows", os.environ.get("CELL_ROWS", "40"))
        spark.conf.set("tidemark.block.rows", os.environ.get("BLOCK_ROWS", "64"))
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    queries, oracles = load()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, base)
            got = df.collect()
            dt = time.time() - t0
            if name not in oracles:
                print(f"rows {name}: {len(got)} rows, {dt:.2f}s {df.dtypes}", flush=True)
                continue
            t1 = time.time()
            cur = con.execute(oracles[name])
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {oracles[name]}").fetchall()}
            sql_s = time.time() - t1
            a, b = rows_of(df.columns, got), rows_of(names, want)
            diff_types = {c: (t, types.get(c)) for c, t in df.dtypes if TYPES.get(types.get(c), "?") != t}
            if sorted(df.columns) != sorted(names) or a != b or diff_types:
                bad += 1
                print(f"BAD  {name}: rows {len(a)} vs {len(b)} types {diff_types} cols {sorted(set(df.columns) ^ set(names))}", flush=True)
                print("   ", sorted(df.columns))
                sa, sb = set(a), set(b)
                for x in sorted(sa - sb)[:3]:
                    print("   spark", x)
                for x in sorted(sb - sa)[:3]:
                    print("   sql  ", x)
                print("   differing", len(sa - sb), len(sb - sa))
            else:
                print(f"ok   {name}: {len(a)} rows, spark {dt:.2f}s sql {sql_s:.2f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:400]}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
