"""Runs a query beside its SQL check and reports differences.

``python -m tests.compare [-d dir] [name ...]`` compares from the command line.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from concord.plans.registry import checks, queries
from concord.sources.shaped import BASE_TABLES

DATA = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, int):
        return f"{v:.6f}" if False else str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if type(v).__name__ == "Decimal":
        return f"DEC{v}"
    return str(v)


def differences(spark, con, sf_dir: str, name: str) -> str | None:
    """None if rows, names and values agree, else a short account of what differs."""
    df = queries()[name](spark, sf_dir)
    rel = con.sql(checks()[name])
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(set(df.columns) ^ set(rel.columns))}"
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    order = [rel.columns.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            left, right = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
            a, b = left[0], right[0]
            cells = [f"{c}: {x!r} vs {y!r}" for c, x, y in zip(names, a, b) if x != y]
            return f"{len(left)} rows differ, first {a[:3]}: " + "; ".join(cells)[:1500]
    return None


if __name__ == "__main__":
    from concord.session import local_session

    args = sys.argv[1:]
    data = DATA
    if args[:1] == ["-d"]:
        data, args = args[1], args[2:]
    spark, con = local_session(8), connect(data)
    for name in args or list(queries()):
        start = time.time()
        try:
            if name in checks():
                found = differences(spark, con, data, name) or "same"
            else:
                found = f"rows only: {len(queries()[name](spark, data).collect())}"
        except Exception as e:  # report and go on to the next query
            found = f"ERROR {str(e).splitlines()[0][:700]}"
        print(f"{name}: {found} ({time.time() - start:.1f}s)", flush=True)
