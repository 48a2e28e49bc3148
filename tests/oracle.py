"""Runs queries beside their SQL: python tests/oracle.py [sf] [name...]."""

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con, sql):
    """Rows of each side that the other lacks, at most five, or differing columns."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", df.columns, names)]
    order = sorted(names)
    a = Counter(tuple(_cell(r[c]) for c in order) for r in got)
    at = [names.index(c) for c in order]
    b = Counter(tuple(_cell(r[i]) for i in at) for r in cur.fetchall())
    return [("only here", *x) for x in list(a - b)[:5]] + [("only in SQL", *x) for x in list(b - a)[:5]] + ([("no rows",)] if not a else [])


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf), e.oracle_sql()
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            if name in sql:
                bad = differences(f(spark, sf), con, sql[name])
                print(name, "ok" if not bad else f"DIFFERS {bad}", round(time.time() - t, 1), flush=True)
            else:
                print(name, "rows", f(spark, sf).count(), round(time.time() - t, 1), flush=True)
        except Exception as x:
            print(name, "FAILS", str(x)[:600], flush=True)
