"""Run named queries next to their SQL in DuckDB: python scripts/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablewarden.plans import registry  # noqa: E402
from tablewarden.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        return f"{v:.6g}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(normal(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in registry.ORACLE:
        return f"rows-only ({len(got)} rows)"
    cur = con.execute(registry.ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return (f"FAIL rows {len(a)} vs {len(b)}\n   spark {[x for x in a if x not in sb][:3]}"
                f"\n   sql   {[x for x in b if x not in sa][:3]}")
    return f"ok ({len(a)} rows)" if a else "ok EMPTY"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    registry.load_all()
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in registry.QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            msg = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            msg = "FAIL " + str(e)[:700] + "\n" + "".join(traceback.format_exc().splitlines(True)[-3:])
        bad += msg.startswith("FAIL")
        print(f"{name:40s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
