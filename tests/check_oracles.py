"""Compare registered queries with their SQL twins: python tests/check_oracles.py [--sf DIR] [names or prefixes]."""

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, name, query, sql, sf):
    """(ok, message) for one query; values must be equal exactly."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    t0 = time.time()
    df = query(spark, sf)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no twin, {t1 - t0:.1f}s"
    rel = con.execute(sql)
    want_cols, want = [c[0] for c in rel.description], rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    a, b = rows(got_cols, got), rows(want_cols, want)
    if a != b:
        sa, sb = set(a) - set(b), set(b) - set(a)
        return False, f"rows {len(a)} vs {len(b)}; {sorted(got_cols)}\n   spark {sorted(sa)[:3]}\n   duck  {sorted(sb)[:3]}"
    return True, f"{len(a)} rows, spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--skip", type=int, default=0)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as E
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    q, o = E.queries(), E.oracle_sql()
    bad = []
    names = [n for n in q if not a.names or any(n.startswith(x) for x in a.names)][a.skip:]
    for n in names:
        try:
            ok, msg = compare(spark, n, q[n], o.get(n), a.sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:500]}"
        print(("ok   " if ok else "FAIL ") + n + "  " + msg, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")


if __name__ == "__main__":
    main()
