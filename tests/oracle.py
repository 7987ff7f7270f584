"""Compares a query with its SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")[:26]
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        return round(float(value), 9)
    return value


def rows_of_sql(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    """'' if both give the same rows."""
    a_names, a = rows_of_frame(df)
    b_names, b = rows_of_sql(sql, sf_dir)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a == b:
        return ""
    wrong = next(((x, y) for x, y in zip(a, b) if x != y), ("", ""))
    return f"{len(a)} and {len(b)} rows; {str(wrong[0])[:300]} / {str(wrong[1])[:300]}"
