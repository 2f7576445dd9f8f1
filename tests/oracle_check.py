"""Compare every query with its SQL counterpart: `python -m tests.oracle_check [folder] [names…]`."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

import __spark_entry__ as entry_points
from kpiloom.session import local_session


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def compare(frame, connection, sql: str) -> str | None:
    """None when both results are the same bag of rows, else what differs."""
    found_columns = frame.columns
    described = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    expected = connection.execute(sql)
    expected_columns = [d[0] for d in expected.description]
    if sorted(found_columns) != sorted(expected_columns):
        return f"columns {found_columns} against {expected_columns}"
    types = {name: TYPES.get(kind, kind) for name, kind in frame.dtypes}
    if types != described:
        return f"types {sorted(types.items() ^ described.items())}"
    found = bag(frame.collect(), found_columns)
    wanted = bag(expected.fetchall(), expected_columns)
    if found == wanted:
        return None if found else "both empty"
    return f"{sum(found.values())}/{sum(wanted.values())} rows; only here {list((found - wanted).items())[:2]}; only there {list((wanted - found).items())[:2]}"


def main(folder: str, names: list[str]) -> int:
    spark, connection = local_session(8), duck(folder)
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    for name in names or sql:
        begin = time.time()
        try:
            problem = compare(queries[name](spark, folder), connection, sql[name])
        except Exception as error:  # keep going: one report for all
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - begin:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names or sql)} queries, {bad} differ")
    spark.stop()
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(bool(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:])))
