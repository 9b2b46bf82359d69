"""Holding a query's rows against its SQL twin in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb

SF = Path("/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v).isoformat()
    return v


def compare(spark, query, sql, folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f if f.is_file() else f / '*.parquet'}'")
    df = query(spark, str(folder))
    names = sorted(df.columns)
    answer = con.execute(sql)
    own = [d[0] for d in answer.description]
    assert sorted(own) == names
    expected = Counter(tuple(_plain(r[own.index(n)]) for n in names) for r in answer.fetchall())
    got = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
