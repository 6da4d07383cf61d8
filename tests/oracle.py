"""Compares a query with its SQL as sorted rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, list):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, db, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    answer = db.sql(sql)
    want = rows_of(answer.columns, answer.fetchall())
    if sorted(df.columns) != sorted(answer.columns):
        return f"columns {sorted(df.columns)} and {sorted(answer.columns)}"
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    theirs = {c: str(t) for c, t in zip(answer.columns, answer.types)}
    odd = {c: (t, theirs[c]) for c, t in df.dtypes if t in types and types[t] != theirs[c]}
    if odd:
        return f"types {odd}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only here {a}; only there {b}"
    return None if got else "empty"
