"""Run queries beside their SQL and compare: `python tests/oracle_check.py [sf dir] [name …]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return "NULL" if value is None else f"{type(value).__name__}:{value}"


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(_cell(row[c]) for c in columns) for row in df.collect())


def oracle_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    places = [names.index(c) for c in columns]
    return columns, sorted(tuple(_cell(row[i]) for i in places) for row in result.fetchall())


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    mine, theirs = spark_rows(df), oracle_rows(con, sql)
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if mine[1] == theirs[1]:
        return None
    only_mine, only_theirs = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
    return (
        f"{len(mine[1])} rows against {len(theirs[1])}; {mine[0]}\n  only Spark: {sorted(only_mine)[:3]}"
        f"\n  only SQL:   {sorted(only_theirs)[:3]}"
    )


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        started = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            problem = difference(df, con, oracle_sql()[name]) if name in oracle_sql() else "no SQL"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
