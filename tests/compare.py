"""Row-set comparison of a Spark frame with DuckDB SQL over the same files."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v:.6f}"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v if v is None else f"s{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    only_a, only_b = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
    return f"rows {len(a)} / {len(b)}; only spark {only_a}; only sql {only_b}"
