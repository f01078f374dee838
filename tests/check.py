"""Run queries and their SQL side by side: ``python tests/check.py <sf_dir> [names...]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="checkpoints-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.date() if v.time() == datetime.time(0) else v
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(_value(r[i])) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out)


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return normal([d[0] for d in cur.description], cur.fetchall())


def compare(got, want):
    if got[0] != want[0]:
        return f"columns {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(got[0], a, b) if x != y]
        return f"{len(bad)} of {len(got[1])} rows differ, e.g. {diff[:4]} in {a[:6]}"
    return None


def main():
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        t0 = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            t1 = time.time()
            if name in sqls:
                want = duck_rows(con, sqls[name])
                problem = compare(got, want)
            else:
                problem = None if got[1] else "no rows"
        except Exception as e:  # noqa: BLE001
            problem, t1, got = f"{type(e).__name__}: {str(e)[:600]}", time.time(), ([], [])
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(got[1])} spark={t1 - t0:.2f}s duck={time.time() - t1:.2f}s "
              f"{'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print(f"{failed} failed; sql without query: {sorted(set(sqls) - set(queries))}")


if __name__ == "__main__":
    main()
