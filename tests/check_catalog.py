"""Compare every named query with its SQL counterpart in DuckDB.

    python tests/check_catalog.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(value):
    import datetime
    import decimal

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return bool(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in records), key=repr)


def compare(spark, folder, name, function, sql):
    """(outcome, rows, seconds, detail) for one query."""
    import duckdb

    from tidemark.catalog.tables import BASE

    started = time.time()
    frame = function(spark, folder)
    names = frame.columns
    got = rows_of([tuple(r) for r in frame.collect()], names)
    seconds = time.time() - started
    if sql is None:
        return "rows only", len(got), seconds, ""
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in BASE:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = connection.execute(sql)
    wanted_names = [d[0] for d in cursor.description]
    wanted = rows_of(cursor.fetchall(), wanted_names)
    if sorted(names) != sorted(wanted_names):
        return "COLUMNS", len(got), seconds, f"{sorted(names)} vs {sorted(wanted_names)}"
    if got != wanted:
        differing = [(a, b) for a, b in zip(got, wanted) if a != b][:3]
        return "DIFFER", len(got), seconds, f"{len(got)} vs {len(wanted)} rows; {sorted(names)} {differing}"
    return "equal", len(got), seconds, ""


def main():
    from tidemark.catalog import load
    from tidemark.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    registry = load()
    chosen = sys.argv[2:] or list(registry.QUERIES)
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in chosen:
        try:
            outcome, count, seconds, detail = compare(spark, folder, name, registry.QUERIES[name], registry.CHECKS.get(name))
        except Exception as error:  # noqa: BLE001
            outcome, count, seconds, detail = "ERROR", 0, 0.0, str(error)[:1500]
        bad += outcome not in ("equal", "rows only")
        print(f"{outcome:10} {name:28} {count:7} rows {seconds:6.2f} s {detail[:1500]}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
