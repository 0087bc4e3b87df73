"""Runs a query and its SQL on the same tables and compares names, types and values."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def differences(frame, db, sql):
    ours, theirs = frame.toArrow(), db.execute(sql).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return f"columns {names} and {sorted(theirs.column_names)}"
    kinds = [(n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in names]
    if wrong := [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]:
        return f"types {wrong}"
    a, b = (sorted(repr(tuple(r[n] for n in names)) for r in t.select(names).to_pylist()) for t in (ours, theirs))
    if a != b:
        return f"{len(a)} and {len(b)} rows, first difference {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return None
