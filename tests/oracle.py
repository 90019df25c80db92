"""Run registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int | None = None):
    from pyspark.sql import SparkSession

    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    s = (
        SparkSession.builder.master(f"local[{n}]")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v)) if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    cols = sorted(names)
    got = [tuple(_norm(row[c]) for c in cols) for row in df.collect()]
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(row[i]) for i in at) for row in want]
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    left, right = Counter(got), Counter(want)
    extra, missing = sorted((left - right).elements()), sorted((right - left).elements())
    return f"{len(extra)} of {len(got)} rows differ, e.g. {cols} {extra[0]} / {missing[0]}" if extra else None


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    import faulthandler
    import signal

    limit = int(os.environ.get("QUERY_LIMIT", "60"))

    def stop(*_):
        raise TimeoutError(f"over {limit} s")

    signal.signal(signal.SIGALRM, stop)
    faulthandler.enable()
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t = time.time()
        signal.alarm(limit)
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows {df.count()}"
        except Exception as e:  # report and go on
            state = "ERROR " + str(e)[:700]
        signal.alarm(0)
        failed += state.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - t:6.1f}s {state}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
