"""Run reports in Spark and their SQL in DuckDB and compare all values: check.py [sf] [name prefix ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
from pyspark.sql import SparkSession

from jobtrail.plans import all_oracle_sql, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cpus: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("jobtrail-check")
    for key, value in {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", t1 - t0
    if got != want:
        missing = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return f"VALUES {len(got)} vs {len(want)}\n   missing {missing}\n   extra {extra}", t1 - t0
    return f"ok {len(got)}" if got else "EMPTY", t1 - t0


def main(sf="sf0.001", *prefixes):
    sf_dir = f"/root/testdata/{sf}"
    print("data:", sf_dir, flush=True)
    spark, con = session(), oracle(sf_dir)
    sqls = all_oracle_sql()
    bad = 0
    for name, query in all_queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            result, took = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as e:
            result, took = f"ERROR {type(e).__name__} {str(e)[:400]}", 0
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name:32} {took:6.2f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
