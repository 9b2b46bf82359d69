"""Read service over the curated tables, as (status, body) without a web server.

Filters run in Spark before rows reach the driver: by partition for days, by
pushed predicates for devices. Bodies are plain dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.plans.pipeline import GOLD, Lake

COUNTS = [
    "telemetry_event_count",
    "identity_event_count",
    "accepted_event_count",
    "rejected_event_count",
    "missing_message_type_count",
    "invalid_message_type_count",
    "invalid_timestamp_count",
    "missing_device_serial_count",
    "unknown_rejection_count",
]
Response = tuple[int, dict]


class Invalid(ValueError):
    """A record breaks the contract of its response."""


def day_of(text: Column) -> Column:
    """A day as yyyy-MM-dd from a date or time text; anything else is unknown."""
    parsed = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ].*)?\s*$"), F.trim(text).try_cast("timestamp_ntz"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit("unknown"))


def quality_rows(table: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Counts per normalised day; unknown days take no part in a period."""
    df = table.select(day_of(F.col("metric_date").cast("string")).alias("metric_date"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COUNTS])
    df = df.groupBy("metric_date").agg(*[F.sum(c).alias(c) for c in COUNTS])
    if date_from or date_to:
        df = df.where("metric_date <> 'unknown'")
    df = _between(df, "metric_date", date_from, date_to)
    total = F.col("accepted_event_count") + F.col("rejected_event_count")
    share = F.when(total > 0, F.bround(F.col("rejected_event_count") / total * 100, 4)).otherwise(F.lit(0.0))
    return df.withColumns({"total_event_count": total, "rejection_percentage": share})


def _between(df: DataFrame, column: str, date_from: date | None, date_to: date | None) -> DataFrame:
    if date_from:
        df = df.where(F.col(column) >= date_from.isoformat())
    if date_to:
        df = df.where(F.col(column) <= date_to.isoformat())
    return df


def daily_rows(table: DataFrame, date_from: date | None = None, date_to: date | None = None, device: str | None = None) -> DataFrame:
    df = _between(table, "event_date", date_from, date_to)
    return df.where(F.col("device_serial") == device) if device else df


def route_rows(table: DataFrame, day: date | None, device: str | None = None) -> DataFrame:
    """Plottable points of a day, or of all days."""
    lat, lon = F.col("latitude"), F.col("longitude")
    df = table.where(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)))
    df = df.where(F.col("event_date") == day.isoformat()) if day else df
    return df.where(F.col("device_serial") == device) if device else df


def route_statistics(points: DataFrame) -> DataFrame:
    """Per device and day: points, ends and greatest speed."""
    by = ("point_sequence", "event_timestamp")
    return points.groupBy("event_date", "device_serial").agg(
        F.count(F.lit(1)).alias("point_count"), F.min_by("event_timestamp", F.struct(*by)).alias("start_at"), F.max_by("event_timestamp", F.struct(*by)).alias("end_at"),
        F.max("speed").alias("maximum_speed"),
    )


def _iso(value) -> str | None:
    return None if value is None else value.isoformat() if hasattr(value, "isoformat") else str(value)


def _record(row) -> dict:
    """A response record: counts are not negative, percentages lie in 0 to 100."""
    out = {k: _iso(v) if hasattr(v, "isoformat") else v for k, v in row.asDict().items()}
    for k, v in out.items():
        if v is not None and ((k.endswith("_count") and v < 0) or (k.endswith("_percentage") and not 0 <= v <= 100)):
            raise Invalid(f"{k} is {v}")
    return out


def _problem(status: int, text: str) -> Response:
    return status, {"detail": text}


# fixed values: where the dashboard runs during development
ORIGINS = ("http://localhost:8080", "http://127.0.0.1:8080", "http://localhost:5173", "http://127.0.0.1:5173")


@dataclass
class Service:
    lake: Lake
    origins: tuple[str, ...] = ORIGINS

    def cross_origin(self, origin: str | None) -> dict[str, str]:
        """Headers for a page of that origin: any method and header, no credentials; none for other origins."""
        if origin not in self.origins:
            return {}
        return {"Access-Control-Allow-Origin": origin, "Access-Control-Allow-Methods": "*", "Access-Control-Allow-Headers": "*", "Vary": "Origin"}

    def routes(self) -> dict[str, Callable[..., Response]]:
        return {
            "/": self.index,
            "/health": self.health,
            "/ready": self.ready,
            "/api/v1/data-quality": self.quality,
            "/api/v1/data-quality/{metric_date}": self.quality_of,
            "/api/v1/daily-summary": self.daily,
            "/api/v1/daily-summary/{event_date}": self.daily_of,
            "/api/v1/routes/{event_date}": self.route,
        }

    def table(self, name: str) -> DataFrame:
        if name not in GOLD:
            raise ValueError(f"unknown table {name}; known are {', '.join(GOLD)}")
        return self.lake.gold[name].read()

    def index(self) -> Response:
        return 200, {"routes": [r for r in self.routes() if r != "/"]}

    def health(self) -> Response:
        return 200, {"status": "ok"}

    def ready(self) -> Response:
        tables, ok = {}, True
        for name, table in self.lake.gold.items():
            try:
                d = table.describe()
                tables[name] = {"ready": True, "version": d["version"], "active_file_count": d["active_file_count"]}
            except FileNotFoundError as e:
                ok = False
                tables[name] = {"ready": False, "error": str(e)}
        return (200 if ok else 503), {"status": "ready" if ok else "not_ready", "tables": tables}

    def quality(self, date_from: date | None = None, date_to: date | None = None) -> Response:
        if date_from and date_to and date_from > date_to:
            return _problem(422, "date_from is after date_to")
        df = quality_rows(self.table("data_quality_summary"), date_from, date_to)
        rows = df.orderBy(F.col("metric_date") == "unknown", F.desc("metric_date")).collect()
        return 200, {"count": len(rows), "items": [_record(r) for r in rows]}

    def quality_of(self, metric_date: str) -> Response:
        wanted = metric_date.strip()
        if wanted.lower() == "unknown":
            wanted = "unknown"
        else:
            try:
                wanted = date.fromisoformat(wanted).isoformat()
            except ValueError:
                return _problem(422, "metric_date must be yyyy-MM-dd or unknown")
        rows = quality_rows(self.table("data_quality_summary")).where(F.col("metric_date") == wanted).collect()
        return (200, _record(rows[0])) if rows else _problem(404, f"no quality summary of {wanted}")

    def daily(
        self, date_from: date | None = None, date_to: date | None = None, device_serial: str | None = None, page_size: int | None = None, after: tuple[str, str] | None = None
    ) -> Response:
        """Days and devices in falling order. With ``page_size`` that many at most, and ``next``: what to give as
        ``after`` for the following page (null: there is none). A page is found by its key, not by counting rows."""
        if date_from and date_to and date_from > date_to:
            return _problem(422, "date_from is after date_to")
        if page_size is not None and page_size < 1:
            return _problem(422, "page_size must be positive")
        df = daily_rows(self.table("device_daily_summary"), date_from, date_to, (device_serial or "").strip() or None)
        if after is not None:
            day, device = after
            df = df.where((F.col("event_date") < day) | ((F.col("event_date") == day) & (F.col("device_serial") < device)))
        df = df.orderBy(F.desc("event_date"), F.desc("device_serial"))
        rows = (df if page_size is None else df.limit(page_size + 1)).collect()
        if page_size is None:
            return 200, {"count": len(rows), "items": [_record(r) for r in rows]}
        more, rows = len(rows) > page_size, rows[:page_size]
        return 200, {"count": len(rows), "items": [_record(r) for r in rows], "next": [str(rows[-1]["event_date"]), rows[-1]["device_serial"]] if more else None}

    def daily_of(self, event_date: date, device_serial: str | None = None) -> Response:
        device = (device_serial or "").strip() or None
        rows = daily_rows(self.lake.gold["device_daily_summary"].read(partitions=[event_date.isoformat()]), event_date, event_date, device).limit(2).collect()
        if not rows:
            return _problem(404, f"no daily summary of {event_date.isoformat()}" + (f" and {device}" if device else ""))
        if len(rows) > 1 and device is None:
            return _problem(409, "several devices on that day: give device_serial")
        return 200, _record(rows[0])

    def route(self, event_date: date, device_serial: str | None = None) -> Response:
        """A day's way as GeoJSON: a line and its two ends, coordinates as [longitude, latitude]."""
        device = (device_serial or "").strip() or None
        day = route_rows(self.lake.gold["device_route_points"].read(partitions=[event_date.isoformat()]), event_date, device)
        devices = [r[0] for r in day.select("device_serial").distinct().limit(2).collect()]
        if not devices:
            return _problem(404, f"no route of {event_date.isoformat()}" + (f" and {device}" if device else ""))
        if len(devices) > 1:
            return _problem(409, "several devices on that day: give device_serial")
        points = day.select("longitude", "latitude", "speed", "event_timestamp").orderBy("point_sequence", "event_timestamp").collect()
        if len(points) < 2:
            return _problem(422, "a route needs two valid points")
        line = [[float(p["longitude"]), float(p["latitude"])] for p in points]
        speeds = [float(p["speed"]) for p in points if p["speed"] is not None]
        first, last = _iso(points[0]["event_timestamp"]), _iso(points[-1]["event_timestamp"])
        about = {"device_serial": devices[0], "event_date": event_date.isoformat(), "point_count": len(points), "start_at": first, "end_at": last, "maximum_speed": max(speeds, default=None)}
        end = lambda role, at, xy: {"type": "Feature", "properties": {"role": role, "device_serial": devices[0], "event_timestamp": at}, "geometry": {"type": "Point", "coordinates": xy}}
        whole = {"type": "Feature", "properties": about, "geometry": {"type": "LineString", "coordinates": line}}
        return 200, {"type": "FeatureCollection", "features": [whole, end("start", first, line[0]), end("end", last, line[-1])]}
