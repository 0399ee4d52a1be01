"""Runs a registered query and its SQL side by side and compares the rows."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int, datetime.date)):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(spark, query, sql, d=SF):
    """Rows that only one of the two has."""
    df = query(spark, d)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols, (sorted(names), cols)
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    return [x for x in zip(ours, theirs, strict=False) if x[0] != x[1]][:3] if len(ours) == len(theirs) else [(len(ours), len(theirs))]
