"""Compare registered queries with their DuckDB oracles.

    python tests/oracle_check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from brightloom.plans import registry  # noqa: E402
from brightloom.sources.tables import TABLES  # noqa: E402


def oracle_connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def nearly_equal(columns, got, names, want):
    """Row sets equal up to the last digits of floating-point cells."""
    order = sorted(columns)

    def shaped(cols, rows):
        at = [cols.index(c) for c in order]
        picked = [[r[i] for i in at] for r in rows]
        key = lambda r: ([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)])
        return sorted(picked, key=key)

    def same(a, b):
        if isinstance(a, float) and isinstance(b, float):
            return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
        return _cell(a) == _cell(b)

    a, b = shaped(list(columns), got), shaped(list(names), want)
    return len(a) == len(b) and all(same(x, y) for r, q in zip(a, b) for x, y in zip(r, q))


def compare(spark, con, folder, name, query, sql, close=False):
    """Return (ok, message, seconds); ``close`` forgives the last digits of floating-point cells."""
    start = time.time()
    df = query(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(got_rows)} (no oracle)", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    got, want = rows_of(df.columns, got_rows), rows_of(names, want_rows)
    if got != want and not (close and nearly_equal(df.columns, got_rows, names, want_rows)):
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        extra = sum(g != w for g, w in zip(got, want))
        return False, f"rows {len(got)} vs {len(want)}; {extra} differ, e.g. {str(diff)[:900]}", took
    return True, f"rows={len(got)}", took


def main(argv):
    from brightloom.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("oracle-check", 8)
    con = oracle_connection(folder)
    queries, oracles = registry.queries(), registry.oracle_sql()
    bad = []
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message, took = compare(spark, con, folder, name, query, oracles.get(name))
        except Exception as err:  # report and go on with the next query
            ok, message, took = False, f"{type(err).__name__}: {str(err)[:1200]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {took:6.2f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
