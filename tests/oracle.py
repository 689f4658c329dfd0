"""Compare registered queries with their SQL: names, types, row counts and values.

Run as ``python tests/oracle.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import collections
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def difference(spark_frame, db, sql):
    """What differs, or None."""
    names = sorted(spark_frame.columns)
    result = db.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in result.description}
    if sorted(sql_types) != names:
        return f"columns {names} != {sorted(sql_types)}"
    for name, kind in spark_frame.dtypes:
        if TYPES.get(kind) not in (sql_types[name], None):
            return f"type of {name}: {kind} != {sql_types[name]}"
    order = [list(sql_types).index(n) for n in names]
    theirs = collections.Counter(tuple(_cell(r[i]) for i in order) for r in result.fetchall())
    ours = collections.Counter(tuple(_cell(r[n]) for n in names) for r in spark_frame.collect())
    if ours != theirs:
        return (f"{sum(ours.values())} rows vs {sum(theirs.values())}; only here {list((ours - theirs).items())[:3]}; "
                f"only in SQL {list((theirs - ours).items())[:3]}")
    return None


def main(sf_dir="/root/testdata/sf0.01", *names):
    from __spark_entry__ import oracle_sql, queries
    from tablevitals.session import local_session

    spark, db, sql = local_session(8), connect(sf_dir), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            found = difference(frame, db, sql[name]) if name in sql else f"rows only: {frame.count()}"
        except Exception as error:  # noqa: BLE001
            found = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += bool(found) and not str(found).startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
    print("failing:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
