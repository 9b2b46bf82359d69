"""Positions: usability, distances and event times, as Columns and as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

EARTH_M = 6_371_000.0


def usable(lat: Column, lon: Column) -> Column:
    """In range, a number, and not the 0/0 of a receiver without a fix."""
    return F.coalesce(
        lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0)), F.lit(False)
    )


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column; one without zone counts as UTC whatever the session's zone."""
    ts = F.col(name)
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(ts)
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def metres(lat1, lon1, lat2, lon2):
    """Great-circle distance; arrays or numbers."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
