"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/oracle.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return (2, "nan")
        return (2, f"{float(v):.6f}".replace("-0.000000", "0.000000"))
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, build, oracle: str | None, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = build(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if oracle is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f}s"
    cur = con.execute(oracle)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = [x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2]
        return False, f"{len(a)} vs {len(b)} rows {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}"
    return True, f"{len(a)} rows, {took:.1f}s"


def main() -> int:
    import __spark_entry__ as E
    from answerscope.session import get_spark

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/{args.sf}"
    spark = get_spark("oracle", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for name in args.names or queries:
        try:
            ok, note = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
