"""Run every query beside its SQL and report differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, query, sql, sf_dir) -> str | None:
    """None if Spark and SQL agree, else what differs."""
    result = query(spark, sf_dir)
    spark_rows = rows_of(result.columns, [tuple(row) for row in result.collect()])
    cursor = connection.execute(sql)
    columns = [column[0] for column in cursor.description]
    sql_rows = rows_of(columns, cursor.fetchall())
    if sorted(result.columns) != sorted(columns):
        return f"columns {sorted(result.columns)} and {sorted(columns)}"
    if spark_rows != sql_rows:
        extra, missing = spark_rows - sql_rows, sql_rows - spark_rows
        return (
            f"{sum(spark_rows.values())} rows and {sum(sql_rows.values())} expected;"
            f" extra {list(extra.items())[:2]} missing {list(missing.items())[:2]}"
        )
    return None


def duckdb_views(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def main(arguments: list[str]) -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from evotrail.session import build_session

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="evotrail-compare-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_views(sf_dir)
    failures = 0
    for name in names:
        started = time.time()
        problem = compare(spark, connection, name, QUERIES[name], ORACLE[name], sf_dir)
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - started:6.2f}s {name}", flush=True)
        if problem:
            print("     ", problem[:1500], flush=True)
    print(f"{len(names) - failures} of {len(names)} agree")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
