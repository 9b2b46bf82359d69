"""Helpers that keep Catalyst from copying expensive expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    A filter on a projected column is pushed down with the column's whole
    expression in place of its name, once per use; expressions that build on each
    other grow exponentially that way. A generator's output is never unfolded.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
