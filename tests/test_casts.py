"""Casts and null-skipping aggregates against DuckDB, on the texts that engines disagree about."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetloom.functions import casts

NUMBERS = [
    None, "", " 1.5 ", "1d", "1f", "1D", "2.F", "1_000", "1__0", "_1", "inf", "-Infinity", "nan", "1e3", "1e", "0x1F", "1,5", "+7", "-0.0", "1 2", ".5", "5.", "abcdef", "1.5d ", "9" * 400, "1_0.5_0",
]
TIMES = [
    None, "", "2026", "2026-07", "2026-07-01", "2026-07-01 10", "2026-07-01 10:00", "2026/07/01 10:00:00", "2026-07-01T10:00:00.123456", "2026-07-01 10:00:00Z", "2026-07-01 10:00:00 UTC",
    "2026-07-01T10:00:00-03:00", "2026-07-01 10:00:00 +0530", "  2026-07-01 10:00:00  ", "2026-02-30 10:00:00", "10:00:00", "junk", "2026-7-1 1:02:03", "2026-07-01 10:61:00", "01/07/2026 10:00:00",
]


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def test_to_double(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBERS)], "i int, t string").select("i", casts.to_double(F.col("t")).alias("v"))
    got = [shown(r["v"]) for r in df.orderBy("i").collect()]
    expected = [shown(duckdb.execute("SELECT TRY_CAST(? AS DOUBLE)", [t]).fetchone()[0]) for t in NUMBERS]
    assert got == expected


def test_to_timestamp(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TIMES)], "i int, t string").select("i", casts.to_timestamp(F.col("t")).alias("v"))
    got = [r["v"] for r in df.orderBy("i").collect()]
    expected = [duckdb.execute("SELECT TRY_CAST(? AS TIMESTAMP)", [t]).fetchone()[0] for t in TIMES]
    assert got == expected


@pytest.mark.parametrize(("number", "whole"), [(1.5, 2), (2.5, 2), (-2.5, -2), (math.nan, None), (math.inf, None), (3e9, None), (None, None)])
def test_to_whole(spark, number, whole):
    assert spark.createDataFrame([(number,)], "v double").select(casts.to_whole(F.col("v"), "int")).first()[0] == whole


def test_rounding(spark):
    values = [8.0125, 2.675, 0.5, -0.5, 1.0005, 33.33333, -2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (2, 3, 4):
        expected = [duckdb.execute(f"SELECT round(?::DOUBLE, {k})", [v]).fetchone()[0] for v in values]
        assert [r[0] for r in df.select(casts.rounded(F.col("v"), k)).collect()] == expected


def test_edges_skip_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5.0, "b"), (2, 6.0, "c"), (3, None, "d")], "t int, v double, id string")
    row = df.select(casts.first_by(F.col("v"), F.col("t"), F.col("id")), casts.last_by(F.col("v"), F.col("t"), F.col("id"))).first()
    assert tuple(row) == (5.0, 6.0)


def test_full_match_sees_line_ends(spark):
    df = spark.createDataFrame([("T10",), ("T10\n",), (None,)], "m string")
    assert [r[0] for r in df.select(casts.full_match(F.col("m"), "T[0-9]+")).collect()] == [True, False, None]
