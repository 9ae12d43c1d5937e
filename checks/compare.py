"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

from basketwise.session import build_session
from checks.oracles import ORACLES
from checks.queries import REGISTERED


def duckdb_connection(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def difference(spark_rows, spark_columns, sql_rows, sql_columns) -> str | None:
    """What differs between two results, rows in any order, or None."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} against {sorted(sql_columns)}"
    order = sorted(spark_columns)
    left = Counter(tuple(row[spark_columns.index(c)] for c in order) for row in spark_rows)
    right = Counter(tuple(row[sql_columns.index(c)] for c in order) for row in sql_rows)
    if left == right:
        return None
    return (
        f"{sum(left.values())} rows against {sum(right.values())}; only in Spark "
        f"{list((left - right).items())[:2]}; only in SQL {list((right - left).items())[:2]}"
    )


def compare(spark, connection, folder: str, name: str) -> str | None:
    frame = REGISTERED[name](spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    if name not in ORACLES:
        return None if rows else "no rows"
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    return difference(rows, frame.columns, result.fetchall(), columns)


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(REGISTERED)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, failures = duckdb_connection(folder), 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, connection, folder, name)
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        mark = "FAIL" if problem else ("same" if name in ORACLES else "rows")
        print(f"{mark} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - failures} of {len(names)} fine")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
