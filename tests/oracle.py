"""Run a named query in Spark and its SQL in DuckDB, and compare the results as multisets of rows."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if value != value else value + 0.0
    return value


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, otherwise what differs."""
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    wanted_types = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "string": "VARCHAR"}
    for field, kind in df.dtypes:
        if kinds[field] != wanted_types.get(kind, kind):
            return f"type of {field}: spark {kind}, duckdb {kinds[field]}"
    at = [names.index(c) for c in columns]
    want = [tuple(normal(r[i]) for i in at) for r in result.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    order = lambda r: tuple((v is None, str(v)) for v in r)
    got.sort(key=order)
    want.sort(key=order)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    from ledgerspark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    picked = sys.argv[2:] or list(queries())
    session, connection = local_session(os.environ.get("TEST_CPUS", "8")), duck_connection(folder)
    failed = []
    for key in picked:
        start = time.time()
        try:
            problem = compare(session, connection, key, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s{'' if key in oracle_sql() else ' (rows only)'}", flush=True)
        if problem:
            print("     ", problem, flush=True)
            failed.append(key)
    print("failed:", failed)
