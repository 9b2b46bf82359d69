"""Repeated consecutive events collapsed to one with count and duration (problem 6).

Only boundary rows count: the first event of each run, with its position and the
time of the event before it. The next boundary then gives the run's count
(difference of positions) and its end (its previous event's time). For runs of
equal values (:func:`collapse_runs`) an event that differs from its predecessor is
a boundary. For runs near their first event (:func:`near_runs`) the boundaries
follow from one another: the next one is the first event out of reach.

A device's days are walked on their own. Two neighbours farther apart than twice the
radius, or too long apart in time, are a sure boundary: no run can hold both. Before
a day's first sure boundary a run of the day before may still be open; it ends where
the day's events first span more than twice the radius, and from wherever it ends
the walks soon meet in one boundary (:func:`meeting`). From there on the day stands by
itself. What meets per device are the few events before that and each day's last,
open run as one row; a day that never spans so much (a parked device) is one row too,
with its circle, and is looked into only where the circle doesn't decide.

Defined cases: rows with a null device or time or an unusable position are left
out; of several events of one device and time the first to arrive stands; runs of
fewer than ``min_events`` are no result; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.geo import EARTH_M, metres
from fleetloom.functions.streams import groups, record_batches
from fleetloom.operators.trips import daily_pings, once_per_time


@dataclass(frozen=True)
class Rules:
    radius_m: float = 60.0
    gap_s: float = 6 * 3600.0
    min_events: int = 3


def _near(anchor: tuple, lat: float, lon: float, radius: float) -> bool:
    p, q = radians(anchor[1]), radians(lat)
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(lon - anchor[2]) / 2) ** 2
    return 2 * EARTH_M * asin(sqrt(min(h, 1.0))) <= radius


def reach(i: int, us, lat, lon, rules: Rules) -> int:
    """The first event after ``i`` that a run beginning there can't hold; the length where there is none."""
    n, a, step = len(us), i + 1, 16
    while a < n:
        b = min(n, a + step)
        off = (metres(lat[i], lon[i], lat[a:b], lon[a:b]) > rules.radius_m) | (us[a:b] - us[a - 1 : b - 1] > rules.gap_s * 1e6)
        if off.any():
            return a + int(off.argmax())
        a, step = b, 4 * step
    return n


def near_next(us, lat, lon, rules: Rules, step: int) -> np.ndarray:
    """Whether each event holds the one ``step`` later, hops in time aside; short by ``step``."""
    return metres(lat[:-step], lon[:-step], lat[step:], lon[step:]) <= rules.radius_m


def shorts(us, lat, lon, rules: Rules) -> np.ndarray:
    """Events whose run is sure to be too short to count, whatever follows these events."""
    n, out = len(us), np.zeros(len(us), bool)
    late = np.diff(us) > rules.gap_s * 1e6
    for step in range(1, rules.min_events):
        if n > step:
            off = ~near_next(us, lat, lon, rules, step) | late[step - 1 :]
            out[: n - step] |= off
    return out


def starts(us, lat, lon, rules: Rules, first: int = 0, short: np.ndarray | None = None) -> tuple[list[int], int]:
    """Positions of the boundaries of a walk that begins at ``first``, up to the first run that the end
    of the events leaves open; that run's position. A run too short to count gives way to its second event."""
    out, i, n = [], first, len(us)
    longer = np.flatnonzero(~(shorts(us, lat, lon, rules) if short is None else short))
    while i < n:
        at = int(np.searchsorted(longer, i))
        k = int(longer[at]) if at < len(longer) else n
        if k > i:
            out += range(i, k)
            i = k
            continue
        j = reach(i, us, lat, lon, rules)
        if j == n:
            break
        out.append(i)
        i = j if j - i >= rules.min_events else i + 1
    return out, i


def meeting(us, lat, lon, rules: Rules, last: int, end: int, short: np.ndarray) -> int:
    """The first boundary that the walks from all of the first ``last`` + 1 events share, ``end`` at the latest."""
    on = np.zeros(end + 1, bool)
    on[: last + 1] = True
    left, i = last + 1, 0
    while left > 1:
        while not on[i]:
            i += 1
        j = i + 1 if short[i] else reach(i, us, lat, lon, rules)
        if j < len(us) and not short[i]:  # else the run is open beyond these events, and so is what follows it
            j = j if j - i >= rules.min_events else i + 1
        left -= on[j]
        on[j], on[i] = True, False
    return int(on.argmax())


def spanning(lat, lon, rules: Rules) -> int | None:
    """The first event by which the events surely span more than twice the radius; None: they may not."""
    low, high, west, east = (f.accumulate(x) for x in (lat, lon) for f in (np.minimum, np.maximum))
    tall, wide = np.radians(high - low) * EARTH_M, np.radians(east - west) * EARTH_M
    wide = np.where(east - west < 90, 0.999 * wide * np.cos(np.radians(np.maximum(np.abs(low), np.abs(high)))), 0.0)
    far = np.maximum(tall, wide) > 2.001 * rules.radius_m
    return int(far.argmax()) if far.any() else None


class Boundaries:
    """The run that a device's walk has open: its first event, its second while it is too short to count,
    its count and its last time."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.gap_us = rules, rules.gap_s * 1e6
        self.anchor: tuple | None = None
        self.second: tuple | None = None
        self.count = self.last = 0

    def _begin(self, us: int, lat: float, lon: float, count: int = 1, last: int | None = None) -> None:
        self.anchor, self.second, self.count, self.last = (us, lat, lon), None, count, us if last is None else last

    def end(self) -> tuple | None:
        """The open run (first_us, last_us, count) if it counts."""
        if self.anchor is not None and self.count >= self.rules.min_events:
            return self.anchor[0], self.last, self.count
        return None

    def fresh(self, us: int, lat: float, lon: float, count: int, last: int) -> tuple | None:
        """A boundary whatever came before, with the events of its run so far; gives the run that it ends."""
        done = self.end()
        self._begin(us, lat, lon, count, last)
        return done

    def holds(self, us: int, last: int, lat: float, lon: float, circle: float, count: int) -> bool:
        """Whether the open run takes all events of a circle; if so it has taken them."""
        if self.anchor is None or us - self.last > self.gap_us or float(metres(*self.anchor[1:], lat, lon)) + circle > self.rules.radius_m:
            return False
        self.count, self.last = self.count + count, last
        return True

    def one(self, us: int, lat: float, lon: float) -> tuple | None:
        """Take one further event; gives the run that it ends."""
        done = None
        while self.anchor is not None:
            if us - self.last <= self.gap_us and _near(self.anchor, lat, lon, self.rules.radius_m):
                self.count, self.last = self.count + 1, us
                if self.count == 2:
                    self.second = (us, lat, lon)
                return done
            if self.count >= self.rules.min_events:
                done, self.anchor = self.end(), None
            elif self.count == 2:
                self._begin(*self.second)
            else:
                self.anchor = None
        self._begin(us, lat, lon)
        return done

    def push(self, us, lat, lon) -> Iterator[tuple]:
        """Take further events, at least one; gives the runs that they end."""
        i, n = 0, len(us)
        while i < n:
            if self.anchor is None:
                self._begin(int(us[i]), float(lat[i]), float(lon[i]))
                i += 1
                continue
            at, y, x = self.anchor
            # the open run's last time and place stand before the events
            j = i + reach(0, np.r_[self.last, us[i:]], np.r_[y, lat[i:]], np.r_[x, lon[i:]], self.rules) - 1
            if j > i:
                if self.count == 1:
                    self.second = (int(us[i]), float(lat[i]), float(lon[i]))
                self.count, self.last = self.count + j - i, int(us[j - 1])
            if j < n:
                if run := self.end():
                    yield run
                    self.anchor = None
                elif self.count == 2:
                    self._begin(*self.second)
                else:
                    self.anchor = None
            i = j


_PARTS = pa.schema(
    [("device_serial", pa.string()), ("us", pa.int64()), ("last_us", pa.int64()), ("n", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("circle", pa.float64()), ("kind", pa.string()), ("body", pa.binary())]
)
PARTS = "device_serial string, us bigint, last_us bigint, n bigint, lat double, lon double, circle double, kind string, body binary"


def day_parts(device: str, us, lat, lon, rules: Rules) -> Iterator[tuple]:
    """A day as closed runs (kind ``run``), events before its first own boundary (``event``, or all in one
    ``circle``) and the boundary of its open run (``fresh``)."""
    us, lat, lon = once_per_time(us, lat, lon)
    n = len(us)
    hop = metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
    sure = np.flatnonzero((hop > 2 * rules.radius_m) | (np.diff(us) > rules.gap_s * 1e6))
    own = int(sure[0]) + 1 if len(sure) else n
    far, short = spanning(lat[:own], lon[:own], rules), shorts(us, lat, lon, rules)
    if far is not None:
        own = meeting(us, lat, lon, rules, far, own, short)
    if far is None and own >= 8:
        y, x = (float(c[:own].min() + c[:own].max()) / 2 for c in (lat, lon))
        body = b"".join(c[:own].tobytes() for c in (us.astype(np.int64), lat, lon))
        yield device, int(us[0]), int(us[own - 1]), own, y, x, float(metres(y, x, lat[:own], lon[:own]).max()), "circle", body
    else:
        for k in range(own):
            yield device, int(us[k]), int(us[k]), 1, float(lat[k]), float(lon[k]), None, "event", None
    if own < n:
        at, rest = starts(us, lat, lon, rules, own, short)
        count = np.diff([*at, rest])
        for i in np.flatnonzero(count >= rules.min_events).tolist():
            yield device, int(us[at[i]]), int(us[at[i] + count[i] - 1]), int(count[i]), None, None, None, "run", None
        if n - rest >= rules.min_events:
            yield device, int(us[rest]), int(us[n - 1]), n - rest, float(lat[rest]), float(lon[rest]), None, "fresh", None
        else:
            for k in range(rest, n):
                yield device, int(us[k]), int(us[k]), 1, float(lat[k]), float(lon[k]), None, "fresh" if k == rest else "event", None


def near_runs(pings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(device_serial, first_s, last_s, event_count) of the longest runs near their first event."""

    def per_day(batches):
        rows = (r for (device, _), (us, lat, lon) in groups(batches, 2) for r in day_parts(device, us, lat, lon, rules))
        yield from record_batches(rows, _PARTS)

    def per_device(batches):
        runs, device = Boundaries(rules), None

        def shown(found):
            for first, last, n in found:
                yield device, first, last, n, None, None, None, "run", None

        def closed(rows):
            nonlocal runs, device
            for d, us, last, n, lat, lon, circle, kind, body in rows:
                if d != device:
                    yield from shown(filter(None, [runs.end()]))
                    runs, device = Boundaries(rules), d
                if kind == "fresh":
                    yield from shown(filter(None, [runs.fresh(us, lat, lon, n, last)]))
                elif kind == "event":
                    yield from shown(filter(None, [runs.one(us, lat, lon)]))
                elif not runs.holds(us, last, lat, lon, circle, n):
                    times, places = np.frombuffer(body, np.int64, n), np.frombuffer(body, np.float64, 2 * n, 8 * n)
                    yield from shown(runs.push(times, places[:n], places[n:]))

        for b in batches:
            kept = pa.compute.equal(b.column("kind"), "run")
            yield b.filter(kept)
            yield from record_batches(closed(zip(*(c.to_pylist() for c in b.filter(pa.compute.invert(kept)).columns))), _PARTS)
        yield from record_batches(shown(filter(None, [runs.end()])), _PARTS)

    # finished runs pass by, spread over salts; what is open meets at its device
    salt = F.when(F.col("kind") == "run", F.pmod(F.xxhash64("us"), F.lit(64))).otherwise(F.lit(-1))
    parts = daily_pings(pings).mapInArrow(per_day, PARTS).withColumn("salt", salt)
    parts = parts.repartition("device_serial", "salt").sortWithinPartitions("device_serial", "salt", "us").drop("salt")
    runs = parts.mapInArrow(per_device, PARTS)
    return runs.select(
        "device_serial", F.floor(F.col("us") / 1_000_000).alias("first_s"), F.floor(F.col("last_us") / 1_000_000).alias("last_s"), F.col("n").alias("event_count")
    )


def collapse_runs(df: DataFrame, keys: list[str], order: str, values: list[str], bucket: str) -> DataFrame:
    """Runs of equal consecutive ``values`` per key: first, last, event_count, duration.

    ``order`` is a number unique within a key, and ``bucket`` a coarse monotone
    part of it that spreads a hot key. Boundary rows are found per bucket; only
    they, and each bucket's last row, meet per key. Nulls equal nulls.
    """
    near, whole = Window.partitionBy(*keys, bucket).orderBy(order), Window.partitionBy(*keys).orderBy(order)
    now = F.struct(*[F.col(v) for v in values])
    df = df.where(F.col(order).isNotNull()).select(*keys, bucket, order, *values)
    df = df.withColumns({"__prev": F.lag(now).over(near), "__before": F.lag(order).over(near), "__pos": F.row_number().over(near), "__last": F.lead(order).over(near).isNull()})
    starts = (F.col("__pos") == 1) | ~now.eqNullSafe(F.col("__prev"))
    edge = df.withColumn("__start", starts).where(F.col("__start") | F.col("__last"))
    # per key: each bucket's size so far makes positions global, its last row decides the next bucket's first
    size = F.when(F.col("__last"), F.col("__pos")).otherwise(F.lit(0))
    edge = edge.withColumns(
        {
            "__at": F.col("__pos") + F.coalesce(F.sum(size).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__was": F.lag(now).over(whole), "__was_at": F.lag(order).over(whole), "__end": F.max(order).over(Window.partitionBy(*keys)),
        }
    )
    first = F.col("__pos") == 1
    edge = edge.withColumn("__all", F.max(F.when(F.col(order) == F.col("__end"), F.col("__at"))).over(Window.partitionBy(*keys)))
    real = edge.where(F.col("__start") & (~first | F.col("__was_at").isNull() | ~now.eqNullSafe(F.col("__was"))))
    real = real.withColumn("__before", F.when(first, F.col("__was_at")).otherwise(F.col("__before")))
    count = F.coalesce(F.lead("__at").over(whole), F.col("__all") + 1) - F.col("__at")
    last = F.coalesce(F.lead("__before").over(whole), F.col("__end"))
    return real.select(*keys, *values, F.col(order).alias("first"), last.alias("last"), count.cast("bigint").alias("event_count")).withColumn("duration", F.col("last") - F.col("first"))
