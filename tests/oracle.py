"""Compare a query with its SQL twin, as the driver does."""

import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings dataset conversations train val predictions benchmark".split()


def duck(base=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{base}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def _norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_norm(r[i])) for i in order) for r in rows)


def same(spark, query, sql, base=DATA):
    df = query(spark, base)
    c = duck(base)
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, want.fetchall())
    assert len(got) == len(want)
    assert got == want
