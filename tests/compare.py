"""Hold queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v != v:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, float):
        return f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    try:
        return norm(float(v)) if not isinstance(v, (str, bytes, int)) and hasattr(v, "__float__") else str(v)
    except (TypeError, ValueError):
        return str(v)


def table_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in at], sorted("|".join(norm(r[i]) for i in at) for r in rows)


def differ(spark, con, sf_dir, run, sql) -> str:
    """What differs, or an empty string."""
    df = run(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    c = con.execute(sql)
    want = table_of([d[0] for d in c.description], c.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} {len(want[1])}; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return "" if got[1] else "no rows"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, names = connect(sys.argv[1]), sys.argv[2:]
    for name, run in e.queries().items():
        if names and name not in names or not names and (name.startswith("op") and name[2:3].isdigit() or name == "pipeline"):
            continue
        t = time.time()
        try:
            sql = e.oracle_sql().get(name)
            out = differ(spark, con, sys.argv[1], run, sql) if sql else f"no SQL, {run(spark, sys.argv[1]).count()} rows"
        except Exception as x:
            out = "ERROR " + str(x)[:500]
        print(f"{time.time() - t:5.1f} {name}: {out or 'ok'}", flush=True)
