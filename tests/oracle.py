"""Compare a query with its SQL form on the same tables."""

import glob
import math
import os

import duckdb


def sql_rows(sf_dir, sql):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = db.execute(sql)
    odd = [c[:2] for c in found.description if str(c[1]) not in ("BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN")]
    assert not odd, f"types without a plain Spark counterpart: {odd}"
    return [c[0] for c in found.description], found.fetchall()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark, build, sql, sf_dir):
    """Description of the first difference, or None."""
    df = build(spark, sf_dir)
    odd = [c for c in df.dtypes if c[1] not in ("bigint", "double", "string", "boolean")]
    assert not odd, f"types without a plain SQL counterpart: {odd}"
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    want = normal(*sql_rows(sf_dir, sql))
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None if got[1] else "no rows"
