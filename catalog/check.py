"""Compare registered queries with their SQL: ``python -m catalog.check [--sf DIR] [names...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import tempfile
import time

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    """A value both engines print alike."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, decimal.Decimal)):
        return f"{float(value):.12g}" if abs(value) < 1e15 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_connection(sf_dir: str = SF_DIR):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str = SF_DIR) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows {len(got[1])} in {took:.1f}s (no SQL)"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    took_sql = time.time() - start
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        return False, (f"rows {len(got[1])} != {len(want[1])}; columns {got[0]}\n   spark only: {extra}\n   sql only:   {missing}")
    return True, f"{len(got[1])} rows, spark {took:.1f}s, sql {took_sql:.1f}s"


def main(argv: list[str]) -> int:
    from catalog import ORACLES, QUERIES
    from weirworks.session import local_session
    spark = local_session(os.environ.get("CHECK_CPUS", "8"), work=tempfile.mkdtemp(prefix="check-"))
    con = oracle_connection()
    bad = 0
    for name in argv or list(QUERIES):
        try:
            ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + name + ": " + note, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
