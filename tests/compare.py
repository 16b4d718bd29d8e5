"""Rows of a Spark query against those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else path / '*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


def differences(df, con, sql):
    """What tells the two results apart: columns, counts, or the first rows that only one has."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    order = sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.select(*order).collect()), key=key)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=key)
    if a == b:
        return []
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    return [("rows", len(a), len(b), only_a[:3], only_b[:3])]
