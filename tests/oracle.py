"""Run a query and its SQL twin on the same tables and compare all rows."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if type(x).__name__ == "Decimal":
        return round(float(x), 9)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, f, sql, sf_dir):
    """(equal, message)"""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names, data = [d[0] for d in cur.description], cur.fetchall()
    df = f(spark, sf_dir)
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, data)
    if a != b:
        return False, f"{len(got)} and {len(data)} rows; only Spark {list((a - b).items())[:2]}; only SQL {list((b - a).items())[:2]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import time

    import __spark_entry__ as entry
    from lodestone.session import local_session

    spark = local_session(cores=int(os.environ.get("CORES", "6")), partitions=4)
    spark.sparkContext.setLogLevel("OFF")
    wanted, sqls = sys.argv[1:], entry.oracle_sql()
    for name, f in entry.queries().items():
        if name in sqls and (not wanted or any(w in name for w in wanted)):
            t = time.time()
            try:
                ok, said = compare(spark, f, sqls[name], os.environ.get("SF_DIR", "/root/testdata/sf0.01"))
            except Exception as e:  # noqa: BLE001
                ok, said = False, str(e)[:700]
            print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f}s", said[:900], flush=True)
