"""Comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

TYPE_NAMES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP", "smallint": "SMALLINT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v else "0.0"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def compare(df, rows, con, sql: str) -> str | None:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = [
        (c, t, types[c]) for c, t in df.dtypes if TYPE_NAMES.get(t, t.upper()) != types[c]
    ]
    other = rel.fetchall()
    if len(rows) != len(other):
        return f"rows {len(rows)} != {len(other)}"
    order = sorted(names)
    idx = [names.index(c) for c in order]
    a = Counter(tuple(_norm(r[c]) for c in order) for r in rows)
    b = Counter(tuple(_norm(r[i]) for i in idx) for r in other)
    if a != b:
        mine, theirs = sorted((a - b).elements()), sorted((b - a).elements())
        return f"{len(mine)} rows differ {order} spark={mine[:2]} duck={theirs[:2]}"
    return f"types {wrong}" if wrong else None
