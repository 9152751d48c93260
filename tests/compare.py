"""Runs registered queries next to their SQL: ``python tests/compare.py [sf] [name ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as driver  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def difference(spark, db, folder, name):
    """None if rows, types and values agree, else what differs."""
    result = driver.queries()[name](spark, folder)
    columns = sorted(result.columns)
    got = sorted(tuple(row) for row in result.select(*columns).collect())
    answer = db.sql(driver.oracle_sql()[name])
    if sorted(answer.columns) != columns:
        return f"columns {columns} != {sorted(answer.columns)}"
    kinds = {c: str(t) for c, t in zip(answer.columns, answer.types)}
    for column, kind in result.dtypes:
        if SPARK_TO_DUCK.get(kind) != kinds[column]:
            return f"{column}: {kind} != {kinds[column]}"
    want = sorted(answer.select(*columns).fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    from quillvec.session import build_session

    scale, names = (sys.argv[1:2] or ["0.01"])[0], sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name in names or driver.queries():
        start = time.time()
        try:
            if name in driver.oracle_sql():
                outcome = difference(spark, db, folder, name)
            else:
                outcome = f"rows only: {driver.queries()[name](spark, folder).count()}"
                print(f"{name:20s} {time.time() - start:6.2f}s {outcome}", flush=True)
                continue
        except Exception as problem:
            outcome = f"{type(problem).__name__}: {str(problem)[:1500]}"
        failed += outcome is not None
        print(f"{name:20s} {time.time() - start:6.2f}s {outcome or 'same'}", flush=True)
    print("failed:", failed)
