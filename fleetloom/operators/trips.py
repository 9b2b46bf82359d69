"""Stops and trips from location pings (problem 3).

A device's day is cleaned (unusable fixes, repeated times, single stray fixes),
split into sessions at gaps, and each session is simplified by the
time-synchronised Douglas-Peucker method. Low-speed segments between retained
points are dwells; an exact check then grows or shrinks a dwell to the readings
within ``radius`` of its median place. Days are joined by a pass over a device's
dwells and session ends only: silence at a place and single outliers don't end a
stay. Stays of ``min_stop_s`` are stops; what lies between two stops is a trip,
with the length of its retained points.

The unit of work is a device and a day, so a device with a third of all rows is
spread over its days; the joining pass sees some rows per stop, one at a time.

Defined cases: rows with a null device or time, or an unusable position, are
left out; of several rows of one device and time the first to arrive counts;
a device with fewer than two stops has no trip; empty input gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.geo import epoch_us, metres, usable
from fleetloom.functions.streams import groups, record_batches

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Rules:
    radius_m: float = 100.0
    min_stop_s: float = 300.0
    session_gap_s: float = 1800.0
    tolerance_m: float = 50.0
    low_speed: float = 1.0  # metres a second between retained points
    stray_speed: float = 70.0  # metres a second that no vehicle keeps


def daily_pings(pings: DataFrame, arrived: str = "ingested_at") -> DataFrame:
    """Usable pings, together by device and day and in order of time, then arrival."""
    extra = [c for c in (arrived, "row_id") if c in pings.columns]
    df = pings.where(F.col("device_serial").isNotNull() & F.col("event_timestamp").isNotNull() & usable(F.col("latitude"), F.col("longitude"))).select(
        "device_serial", epoch_us(pings, "event_timestamp").alias("us"), "latitude", "longitude", *extra
    )
    df = df.withColumn("day", F.floor(F.col("us") / DAY_US))
    order = ["device_serial", "day", "us", *extra]
    return df.repartition("device_serial", "day").sortWithinPartitions(*order).select("device_serial", "day", "us", "latitude", "longitude")


def once_per_time(us: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    keep = np.r_[True, us[1:] != us[:-1]]
    return [x[keep] for x in (us, *others)]


def without_strays(us, lat, lon, rules: Rules):
    """Drop single fixes off the way: their neighbours are at one place, or both hops to them are too fast."""
    while len(us) >= 3:
        hop = metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
        skip = metres(lat[:-2], lon[:-2], lat[2:], lon[2:])
        dt = np.maximum(np.diff(us) / 1e6, 1.0)
        fast = hop / dt > rules.stray_speed
        off = (hop[:-1] > rules.radius_m) & (hop[1:] > rules.radius_m)
        stray = off & ((skip <= rules.radius_m) | (fast[:-1] & fast[1:] & (skip / (dt[:-1] + dt[1:]) <= rules.stray_speed)))
        # of neighbouring suspects drop the first only, then look again
        stray[1:] &= ~stray[:-1]
        if not stray.any():
            break
        keep = np.r_[True, ~stray, True]
        us, lat, lon = us[keep], lat[keep], lon[keep]
    return us, lat, lon


def simplify(us, x, y, tolerance: float) -> np.ndarray:
    """Indices that the time-synchronised Douglas-Peucker method retains."""
    n = len(us)
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        t = (us[a + 1 : b] - us[a]) / max(us[b] - us[a], 1)
        off = np.hypot(x[a + 1 : b] - (x[a] + t * (x[b] - x[a])), y[a + 1 : b] - (y[a] + t * (y[b] - y[a])))
        k = int(off.argmax())
        if off[k] > tolerance:
            k += a + 1
            keep[k] = True
            todo += [(a, k), (k, b)]
    return np.flatnonzero(keep)


def _dwells(us, lat, lon, kept, rules: Rules) -> list[tuple[int, int, float, float]]:
    """(first, last, lat, lon) of each dwell: merged low-speed segments, checked against their place."""
    hop = metres(lat[kept[:-1]], lon[kept[:-1]], lat[kept[1:]], lon[kept[1:]])
    slow = (hop <= rules.radius_m) & (hop / np.maximum(np.diff(us[kept]) / 1e6, 1.0) <= rules.low_speed)
    out: list[tuple[int, int, float, float]] = []
    i, n = 0, len(us)
    while i < len(slow):
        if not slow[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(slow) and slow[j + 1] and metres(lat[kept[i]], lon[kept[i]], lat[kept[j + 2]], lon[kept[j + 2]]) <= rules.radius_m:
            j += 1
        a, b = int(kept[i]), int(kept[j + 1])
        clat, clon = float(np.median(lat[a : b + 1])), float(np.median(lon[a : b + 1]))
        near = lambda k: metres(clat, clon, lat[k], lon[k]) <= rules.radius_m  # noqa: E731, B023
        low = out[-1][1] + 1 if out else 0
        while a < b and not near(a):
            a += 1
        while b > a and not near(b):
            b -= 1
        while a > low and near(a - 1):
            a -= 1
        while b + 1 < n and near(b + 1):
            b += 1
        if near(a) and a >= low:
            out.append((a, b, clat, clon))
        i = j + 1
        while i < len(slow) and kept[i] < b:
            i += 1
    return out


NODES = "device_serial string, first_us bigint, last_us bigint, n bigint, lat double, lon double, between_n bigint, before_m double, own_m double"
_NODES = pa.schema(
    [("device_serial", pa.string()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("n", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("between_n", pa.int64()), ("before_m", pa.float64()), ("own_m", pa.float64())]
)


def day_nodes(device: str, us, lat, lon, rules: Rules) -> Iterator[tuple]:
    """The dwells of a device's day and the ends of its sessions, in order.

    ``between_n`` readings and ``before_m`` metres along retained points lie
    between a node and the one before it; null metres: the hop is not known here.
    """
    us, lat, lon = without_strays(*once_per_time(us, lat, lon), rules)
    cuts = [0, *(np.flatnonzero(np.diff(us) > rules.session_gap_s * 1e6) + 1).tolist(), len(us)]
    for s, e in zip(cuts, cuts[1:]):
        u, la, lo = us[s:e], lat[s:e], lon[s:e]
        if len(u) == 1:
            yield device, int(u[0]), int(u[0]), 1, float(la[0]), float(lo[0]), 0, None, 0.0
            continue
        scale = np.cos(np.radians(la[0])) * 111_195.0
        kept = simplify(u, (lo - lo[0]) * scale, (la - la[0]) * 111_195.0, rules.tolerance_m)
        spans = _dwells(u, la, lo, kept, rules)
        if not spans or spans[0][0] > 0:
            spans.insert(0, (0, 0, float(la[0]), float(lo[0])))
        if spans[-1][1] < len(u) - 1:
            spans.append((len(u) - 1, len(u) - 1, float(la[-1]), float(lo[-1])))
        on_way = np.zeros(len(u), dtype=bool)
        on_way[kept] = True
        before = -1
        for a, b, clat, clon in spans:
            way = None
            if before >= 0:
                idx = np.unique(np.r_[before, before + np.flatnonzero(on_way[before : a + 1]), a])
                way = float(metres(la[idx[:-1]], lo[idx[:-1]], la[idx[1:]], lo[idx[1:]]).sum())
            yield device, int(u[a]), int(u[b]), b - a + 1, clat, clon, max(a - before - 1, 0), way, 0.0
            before = b


STAYS = "device_serial string, first_us bigint, last_us bigint, n bigint, lat double, lon double, way_m double, way_n bigint"
_STAYS = pa.schema(
    [("device_serial", pa.string()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("n", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("way_m", pa.float64()), ("way_n", pa.int64())]
)


def join_nodes(nodes: Iterator[tuple], rules: Rules) -> Iterator[tuple]:
    """Stops of each device from its nodes in order of time, each with the metres
    and readings since the stop before it. Holds one stay and one outlier."""
    device = stay = held = None
    way_m, way_n, gone = 0.0, 0, 0

    def close():
        nonlocal way_m, way_n
        if stay is not None:
            if (stay[1] - stay[0]) / 1e6 >= rules.min_stop_s:
                yield device, stay[0], stay[1], stay[2], stay[3], stay[4], stay[5], stay[6]
                way_m, way_n = 0.0, 0
            else:
                way_m, way_n = stay[5], stay[6] + stay[2]

    def near(node) -> bool:
        return metres(stay[3], stay[4], node[4], node[5]) <= rules.radius_m

    def begin(node):
        """A new stay, reached from the last one."""
        nonlocal stay, gone
        hop = node[7] if node[7] is not None else 0.0 if stay is None else float(metres(stay[3], stay[4], node[4], node[5]))
        stay, gone = [node[1], node[2], node[3], node[4], node[5], way_m + hop, way_n + node[6]], 0

    def merge(node):
        nonlocal gone
        n = stay[2] + node[3]
        stay[3], stay[4] = (stay[3] * stay[2] + node[4] * node[3]) / n, (stay[4] * stay[2] + node[5] * node[3]) / n
        stay[1], stay[2], gone = max(stay[1], node[2]), n, 0

    for node in nodes:
        if node[0] != device:
            if held is not None:
                yield from close()
                begin(held)
            yield from close()
            device, stay, held, way_m, way_n = node[0], None, None, 0.0, 0
            begin(node)
            continue
        if held is not None:
            if node[6] == 0 and near(node):
                held = None
                merge(node)
                continue
            yield from close()
            begin(held)
            held = None
        if near(node) and node[6] <= 1:
            merge(node)
        elif node[3] == 1 and node[6] == 0:
            held = node  # perhaps a stray fix at a session's edge
        else:
            yield from close()
            begin(node)
    if held is not None:
        yield from close()
        begin(held)
    yield from close()


def stays(pings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All stops, each with the way from the stop before it."""

    def per_day(batches):
        rows = (r for (device, _), (us, lat, lon) in groups(batches, 2) for r in day_nodes(device, us, lat, lon, rules))
        yield from record_batches(rows, _NODES)

    def per_device(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from record_batches(join_nodes(rows, rules), _STAYS)

    nodes = daily_pings(pings).mapInArrow(per_day, NODES)
    return nodes.repartition("device_serial").sortWithinPartitions("device_serial", "first_us", "last_us").mapInArrow(per_device, STAYS)


def stops(pings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return stays(pings, rules).select(
        "device_serial", F.floor(F.col("first_us") / 1_000_000).alias("start_s"), F.floor(F.col("last_us") / 1_000_000).alias("end_s"),
        F.floor((F.col("last_us") - F.col("first_us")) / 1_000_000).alias("duration_s"), F.col("n").alias("reading_count"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
    )


def trips(pings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """What lies between two successive stops of a device."""

    def pairs(batches):
        def run():
            last = None
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if last is not None and last[0] == row[0]:
                        yield row[0], last[2] // 1_000_000, row[1] // 1_000_000, (row[1] - last[2]) // 1_000_000, round(row[6], 1), row[7]
                    last = row

        schema = pa.schema([("device_serial", pa.string()), ("start_s", pa.int64()), ("end_s", pa.int64()), ("duration_s", pa.int64()), ("distance_m", pa.float64()), ("reading_count", pa.int64())])
        yield from record_batches(run(), schema)

    # the stops leave the joining pass by device and in order
    return stays(pings, rules).mapInArrow(pairs, "device_serial string, start_s bigint, end_s bigint, duration_s bigint, distance_m double, reading_count bigint")
