"""Compare a registered query with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import math
import os
import tempfile

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='spark-duckdb-', dir='/tmp')}'")
    con.execute("SET max_temp_directory_size='5GB'")
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    if isinstance(v, dict):
        return {k: canonical(x) for k, x in sorted(v.items())}
    if hasattr(v, "asDict"):
        return canonical(v.asDict())
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([canonical(r[i]) for i in order]) for r in rows)


def compare(df, con, sql):
    """(equal, message)."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        return False, (f"rows {len(got)} vs {len(want)}; only spark: {sorted(a - b)[:3]}; "
                       f"only sql: {sorted(b - a)[:3]}")
    return True, f"{len(got)} rows"
