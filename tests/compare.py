"""Run registered queries against their SQL in DuckDB and compare rows, types and values.

As a script: ``python tests/compare.py <sf_dir> [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# DuckDB type -> Spark types that hold the same values.
SAME_TYPES = {
    "BIGINT": {"bigint"}, "INTEGER": {"int"}, "DOUBLE": {"double"}, "VARCHAR": {"string"}, "BOOLEAN": {"boolean"},
    "DATE": {"date"}, "TIMESTAMP": {"timestamp", "timestamp_ntz"},
}


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(v) if not isinstance(v, float) else f"{v + 0.0:.6g}") for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        if math.isnan(a) and math.isnan(b):
            return True
        return a == b and math.copysign(1, a) == math.copysign(1, b)
    if a is None or b is None:
        return a is b
    if hasattr(a, "tzinfo") and hasattr(b, "tzinfo"):
        return a.replace(tzinfo=None) == b.replace(tzinfo=None)
    return a == b


def mismatch(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    described = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    names = sorted(df.columns)
    if names != sorted(described):
        return f"columns {names} against {sorted(described)}"
    for name, kind in df.dtypes:
        if kind not in SAME_TYPES.get(described[name], set()):
            return f"type of {name}: {kind} against {described[name]}"
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=_key)
    quoted = ", ".join(f'"{c}"' for c in names)
    theirs = sorted(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    if not ours:
        return "no rows at all"
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(map(_same, a, b))]
    return f"{len(bad)} of {len(ours)} rows differ, first {names}: {bad[0]}" if bad else None


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as e
    from tidepanel.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    runs, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for name in names or list(runs):
        started = time.time()
        try:
            df = runs[name](spark, sf)
            problem = mismatch(df, con, sqls[name]) if name in sqls else None
            note = "" if name in sqls else f" (rows only: {df.count()})"
        except Exception as ex:
            problem, note = f"{type(ex).__name__}: {str(ex)[:600]}", ""
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - started:6.2f}s {name}{note} {problem or ''}", flush=True)
    print(f"{failed} failed", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
