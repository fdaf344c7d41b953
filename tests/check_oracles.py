"""Compare registered queries with their SQL on DuckDB.

    python tests/check_oracles.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {r[0]: r[1] for r in described}
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if ours != theirs:
        bad = {c: (ours[c], theirs[c]) for c in cols if ours[c] != theirs[c]}
        return f"types {bad}"
    order = [names.index(c) for c in cols]
    expected = sorted(
        (tuple(_plain(r[i]) for i in order) for r in con.execute(sql).fetchall()), key=_sort_key
    )
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=_sort_key)
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for g, e in zip(got, expected):
        if g != e:
            return f"{cols}: {g} against {e}"
    if not got:
        return "no rows"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    shared = tempfile.TemporaryDirectory(prefix="oracles-")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared.name).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            problem = compare(df, con, sqls[name]) if name in sqls else (
                None if df.collect() else "no rows")
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
