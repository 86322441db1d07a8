"""Compare registered queries with their SQL: names, types and every value.

    python tests/oracle_check.py [sf_dir] [name prefix ...]
"""
from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = query.run(spark, sf_dir)
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    types = {n: str(t) for n, t in zip(names, con.execute(f"DESCRIBE {query.sql}").fetchall())}
    want = con.execute(query.sql).fetchall()
    declared = {r[0]: r[1] for r in con.execute(f"DESCRIBE {query.sql}").fetchall()}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    bad_types = {f.name: (f.dataType.simpleString(), declared[f.name]) for f in df.schema
                 if TYPES.get(f.dataType.simpleString()) != declared[f.name]}
    got_rows, want_rows = rows_of(df.columns, df.collect()), rows_of(names, want)
    del types
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows != {len(want_rows)}"
    diffs = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if diffs:
        return f"{len(diffs)} of {len(got_rows)} rows differ, e.g. {diffs[0]}"
    if bad_types:
        return f"types differ {bad_types}"
    if not got_rows:
        return "no rows: proves nothing"
    return None


def main(argv: list[str]) -> int:
    from panelspark.plans import REGISTRY
    from panelspark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = tuple(argv[1:])
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name, query in REGISTRY.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if query.sql is None:
                n = len(query.run(spark, sf_dir).collect())
                verdict = f"rows only: {n}" if n else "EMPTY"
                ok = n > 0
            else:
                diff = compare(spark, con, query, sf_dir)
                verdict, ok = diff or "equal", diff is None
        except Exception as exc:  # noqa: BLE001 - report every query
            verdict, ok = f"{type(exc).__name__}: {str(exc)[:700]}", False
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
