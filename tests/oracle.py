"""Compare registered queries with their SQL: python tests/oracle.py [sf] [name or prefix ...]."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.sql(sql)
    at = [res.columns.index(c) for c in cols] if sorted(res.columns) == cols else None
    if at is None:
        return f"columns differ: {cols} {sorted(res.columns)}"
    want = sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"rows differ: {len(got)} {len(want)} {bad}"
    return f"ok, {len(got)} rows"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    d = f"/root/testdata/{sf}"
    spark = SparkSession.builder.master(os.environ.get("ORACLE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    for name, q in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = compare(spark, connect(d), q, sql[name], d) if name in sql else f"no SQL, {q(spark, d).count()} rows"
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
