"""Run registered queries and their SQL on the same tables and compare them as multisets of rows.

As a script: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "huge",
    "float": "real", "double": "real", "string": "text", "varchar": "text", "boolean": "bool",
    "timestamp_ntz": "time", "timestamp": "time", "date": "date",
}


def open_tables(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got = df.collect()
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    want = con.execute(sql).fetchall()
    names, kinds = [d[0] for d in described], {d[0]: KINDS.get(d[1].lower(), d[1].lower()) for d in described}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if ours != kinds:
        return f"types {[(n, ours[n], kinds[n]) for n in ours if ours[n] != kinds[n]]}"
    a, b = _rows(got, df.columns), _rows(want, names)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = make_session(), open_tables(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, queries[name], sql[name])
            else:
                rows = queries[name](spark, sf_dir).collect()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(args or queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
