"""Run registered queries beside their SQL and compare all values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _kind(value) -> str:
    return type(value).__name__


def normalised(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    picked = [tuple(row[i] for i in order) for row in rows]
    return [names[i] for i in order], sorted(picked, key=repr)


def compare(spark, sf_dir: str, name: str, connection=None) -> str | None:
    """None if Spark and SQL agree, else what differs first."""
    from querybook import book

    query = book()[name]
    found = query.run(spark, sf_dir)
    ours = normalised(found.columns, [tuple(row) for row in found.collect()])
    if query.sql is None:
        return None if ours[1] else "no rows"
    cursor = (connection or connect(sf_dir)).execute(query.sql)
    theirs = normalised([c[0] for c in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    if not ours[1]:
        return "no rows"
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if repr(a) != repr(b)]
    if different:
        a, b = different[0]
        fields = [(n, x, y) for n, x, y in zip(ours[0], a, b) if repr(x) != repr(y)]
        return f"{len(different)} of {len(ours[1])} rows, first {str(fields)[:600]}"
    return None


def main() -> None:
    from harvestline.session import local_session
    from querybook import book

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(book())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, sf_dir, name, connection)
        except Exception as error:  # keep going, to see every failure at once
            problem = f"{_kind(error)}: {str(error)[:700]}"
        print(f"{name:28s} {time.time() - started:6.2f}s  {problem or 'equal'}", flush=True)


if __name__ == "__main__":
    main()
