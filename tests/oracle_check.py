"""Runs registered queries and their SQL checks side by side.

python tests/oracle_check.py [--sf 0.01] [query ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(item) for item in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def kind(name: str) -> str:
    name = name.lower()
    for short, words in {
        "long": ("bigint",),
        "int": ("int",),
        "text": ("varchar", "string"),
        "float": ("double", "float", "decimal"),
        "bool": ("bool",),
        "time": ("timestamp",),
    }.items():
        if any(word in name for word in words):
            return short
    return name


def compare(df, connection, sql) -> list[str]:
    problems = []
    begun = time.time()
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    compare.spark_seconds = time.time() - begun
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(columns)}")
    types = {item[0]: kind(str(item[1])) for item in cursor.description}
    for name, spark_type in df.dtypes:
        other = types.get(name, "")
        if kind(spark_type) != other:
            problems.append(f"type of {name}: {spark_type} vs {other}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        problems.append(f"values differ\n    spark {extra}\n    check {missing}"[:3000])
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    from tallymark.session import build_session

    SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false").config(
        "spark.ui.enabled", "false"
    ).config("spark.driver.memory", "12g").getOrCreate()
    spark = build_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    folder = f"/root/testdata/sf{args.sf}"
    connection = database(folder)
    checks = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if args.names and name not in args.names:
            continue
        started = time.time()
        try:
            df = query(spark, folder)
            if name in checks:
                problems = compare(df, connection, checks[name])
                note = f"spark {compare.spark_seconds:.1f}s"
            else:
                problems, note = [], f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s {note}", flush=True)
        for problem in problems:
            print("   ", problem, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
