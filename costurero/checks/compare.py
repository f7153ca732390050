"""Run every query on Spark and its SQL on DuckDB over the same files and compare the values.

    python -m costurero.checks.compare FOLDER [query ...]
"""

from __future__ import annotations

import decimal
import sys
import time
from collections import Counter
from datetime import date, datetime

import duckdb
from pyspark.sql import DataFrame, SparkSession

from costurero.checks.oracle import oracle_sql
from costurero.checks.queries import queries
from costurero.sources.derived import STAR


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    if value == 0:
        return type(value)(0)  # -0.0
    return value


def rows_of_spark(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in names]).collect()
    return names, Counter(tuple(_plain(v) for v in r) for r in rows)


def rows_of_duckdb(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = result.fetchall()
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in STAR:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def differences(spark: SparkSession, folder: str, name: str, connection=None) -> list[str]:
    """What differs between both results; empty when nothing does."""
    names, mine = rows_of_spark(queries()[name](spark, folder))
    theirs_names, theirs = rows_of_duckdb(connection or connect(folder), oracle_sql()[name])
    if names != theirs_names:
        return [f"columns {sorted(set(names) ^ set(theirs_names))}"]
    found = []
    for label, extra in (("only in Spark", mine - theirs), ("only in SQL", theirs - mine)):
        if extra:
            found.append(f"{sum(extra.values())} of {sum(mine.values())} rows {label}, such as {min(extra, key=str)}")
    if not mine:
        found.append("no rows")
    return found


def main() -> None:
    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in chosen or queries():
        began = time.time()
        found = differences(spark, folder, name, connection)
        bad += bool(found)
        print(f"{'DIFF' if found else 'same'} {name} {time.time() - began:.1f}s", *found, sep="\n    ", flush=True)
    print(f"{bad} different")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
