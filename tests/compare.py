"""Run named queries in Spark and their SQL in DuckDB, and compare schema and rows."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def canonical(rows, order):
    def text(v):
        return "~" if v is None else f"{v!r}"

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def difference(spark_df, db, sql: str) -> str | None:
    """None when both sides agree, else a short description of the first difference."""
    result = db.execute(sql)
    theirs = [(d[0], str(d[1])) for d in result.description]
    rows = result.fetchall()
    ours = [(n, TYPES.get(t, t)) for n, t in spark_df.dtypes]
    if sorted(ours) != sorted(theirs):
        return f"schema: {sorted(set(ours) ^ set(theirs))}"
    mine = [tuple(r) for r in spark_df.collect()]
    a = canonical(mine, sorted(range(len(ours)), key=lambda i: ours[i][0]))
    b = canonical(rows, sorted(range(len(theirs)), key=lambda i: theirs[i][0]))
    if len(a) != len(b):
        return f"rows: {len(a)} against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        cells = [(p, q) for p, q in zip(*bad[0]) if p != q][:4]
        return f"{len(bad)} of {len(a)} rows differ: {str(cells)[:300]}"
    if not a:
        return "no rows"
    return None


if __name__ == "__main__":
    import __spark_entry__ as contract
    from devprism.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark, db = local_session(), connect(sf_dir)
    oracle = contract.oracle_sql()
    for name, run in contract.queries().items():
        if only and not any(part in name for part in only):
            continue
        start = time.time()
        try:
            if name in oracle:
                found = difference(run(spark, sf_dir), db, oracle[name])
                status = "ok" if found is None else f"FAIL {found}"
            else:
                status = f"rows {run(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            status = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - start:6.1f}s  {status}", flush=True)
