"""Run registered queries next to their SQL in DuckDB.

    python -m tests.oracle sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TESTDATA = "/root/testdata"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, str):
        return value
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)
    return names, data


def compare(df, con, sql: str) -> str | None:
    """``None`` when both give the same rows, else what differs."""
    result = con.execute(sql)
    expected = _rows([d[0] for d in result.description], result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual[0] != expected[0]:
        return f"columns {actual[0]} != {expected[0]}"
    if len(actual[1]) != len(expected[1]):
        return f"rows {len(actual[1])} != {len(expected[1])}; " + _diff(actual, expected)
    if actual[1] != expected[1]:
        return _diff(actual, expected)
    return None


def _diff(actual, expected) -> str:
    a, e = {repr(r) for r in actual[1]}, {repr(r) for r in expected[1]}
    return f"spark only ({len(a - e)}) {sorted(a - e)[:3]}; sql only ({len(e - a)}) {sorted(e - a)[:3]}"


def main() -> int:
    from papertally.catalog import ORACLE, QUERIES
    from papertally.session import local_session

    folder = f"{TESTDATA}/{sys.argv[1]}"
    wanted = sys.argv[2:]
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLE:
                problem = compare(df, con, ORACLE[name])
                said = "ok" if problem is None else f"DIFF {problem[:900]}"
            else:
                problem, said = None, f"rows {df.count()}"
        except Exception as exc:  # report and go on with the next query
            problem, said = exc, f"ERROR {str(exc)[:500]}"
        bad += problem is not None
        print(f"\n{name}: {said} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
