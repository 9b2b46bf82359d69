"""The five curated products over typed telemetry, identities and rejections.

Filters by device or day are semi-joins below the windows, which Catalyst does
not move there by itself. The last sort keys are row and batch id, so every
result is defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.casts import first_by, last_by, mean_of, rounded

MOVING_SPEED = 5
TIE = ("row_id", "batch_id")


def _newest() -> list[Column]:
    return [F.desc_nulls_last("server_timestamp"), F.desc_nulls_last("source_file"), *map(F.desc_nulls_last, TIE)]


def _one_per(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def _within(df: DataFrame, only: DataFrame | None, key: str) -> DataFrame:
    return df if only is None else df.join(only.select(key).distinct(), key, "left_semi").select(*df.columns)


def dedup_telemetry(telemetry: DataFrame) -> DataFrame:
    """The last delivered copy of each message. Numbers compare by their text: 0.0 and -0.0 differ."""
    df = telemetry.where("device_serial IS NOT NULL AND event_timestamp IS NOT NULL")
    text = [F.col(c).cast("string") for c in ("serial_count", "latitude", "longitude", "speed")]
    return _one_per(df, [F.col("device_serial"), F.col("event_timestamp"), F.col("message_type"), *text], _newest())


def dedup_identity(identity: DataFrame) -> DataFrame:
    df = identity.where("device_serial IS NOT NULL AND event_timestamp IS NOT NULL")
    return _one_per(df, [F.col(c) for c in ("device_serial", "event_timestamp", "imei", "imsi", "iccid")], _newest())


def affected_devices(telemetry: DataFrame, identity: DataFrame, dates: DataFrame) -> DataFrame:
    """Devices with an event on one of the days; copies of a message share its device, so none are removed first."""
    parts = [_within(df.where("device_serial IS NOT NULL"), dates, "event_date").select("device_serial") for df in (telemetry, identity)]
    return parts[0].unionByName(parts[1]).distinct()


def dim_device(telemetry: DataFrame, identity: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """One row per device over its whole history. Both kinds of events pass one aggregation, so there is no join."""
    when = [F.col("event_timestamp"), *map(F.col, TIE)]
    own = ["imei", "imsi", "iccid", "identity_auxiliary", "has_valid_imei_format", "has_valid_imsi_format", "has_valid_iccid_format"]
    shared = ["device_serial", "event_timestamp", "protocol_version", *TIE]
    i = dedup_identity(_within(identity, devices, "device_serial")).select(*shared, *own, F.lit(True).alias("is_identity"))
    t = dedup_telemetry(_within(telemetry, devices, "device_serial")).select(*shared, F.lit(False).alias("is_identity"))
    both = i.unionByName(t, allowMissingColumns=True)
    mine, other = F.col("is_identity"), ~F.col("is_identity")
    last = lambda c: last_by(F.when(mine, F.col(c)), *when)
    ts = F.col("event_timestamp")
    grouped = both.groupBy("device_serial").agg(
        last("imei").alias("current_imei"), last("imsi").alias("current_imsi"), last("iccid").alias("current_iccid"), last("identity_auxiliary").alias("current_identity_auxiliary"),
        last("protocol_version").alias("__identity_version"), last_by(F.when(other, F.col("protocol_version")), *when).alias("__telemetry_version"),
        F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"), F.min(F.when(mine, ts)).alias("first_identity_at"), F.max(F.when(mine, ts)).alias("last_identity_at"),
        F.min(F.when(other, ts)).alias("first_telemetry_at"), F.max(F.when(other, ts)).alias("last_telemetry_at"),
        F.count_if(mine).alias("identity_event_count"), F.count_if(other).alias("telemetry_event_count"),
        last("has_valid_imei_format").alias("current_imei_format_valid"), last("has_valid_imsi_format").alias("current_imsi_format_valid"), last("has_valid_iccid_format").alias("current_iccid_format_valid"),
    )
    return grouped.select(
        "device_serial", "current_imei", "current_imsi", "current_iccid", "current_identity_auxiliary",
        F.coalesce("__identity_version", "__telemetry_version").alias("current_protocol_version"), "first_seen_at", "last_seen_at", "first_identity_at", "last_identity_at",
        "first_telemetry_at", "last_telemetry_at", "identity_event_count", "telemetry_event_count", (F.col("identity_event_count") > 0).alias("has_identity_event"),
        (F.col("telemetry_event_count") > 0).alias("has_telemetry_event"), "current_imei_format_valid", "current_imsi_format_valid", "current_iccid_format_valid",
    )


def _positioned(telemetry: DataFrame) -> DataFrame:
    return telemetry.where(F.col("has_valid_coordinates") & ~((F.col("latitude") == 0) & (F.col("longitude") == 0)))


def last_position(telemetry: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    df = _positioned(dedup_telemetry(_within(telemetry, devices, "device_serial")))
    order = [F.desc("event_timestamp"), F.desc_nulls_last("server_timestamp"), F.desc_nulls_last("serial_count"), *map(F.desc_nulls_last, TIE)]
    return _one_per(df, [F.col("device_serial")], order).select(
        "device_serial", F.date_format("event_timestamp", "yyyy-MM-dd").alias("last_position_date"), F.col("event_timestamp").alias("last_position_at"),
        F.col("server_timestamp").alias("received_at"), "latitude", "longitude", "speed", "direction_degrees", "battery_voltage", "internal_battery", "odometer_total",
        "horimeter", "hdop", "rx_level", "message_type", "report_type", "serial_count", "protocol_version", "position_quality", "source_file",
    )


def route_points(telemetry: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Positions in order, numbered per device and day."""
    df = _positioned(dedup_telemetry(_within(telemetry, dates, "event_date")))
    order = [F.asc("event_timestamp"), F.asc_nulls_last("server_timestamp"), F.asc_nulls_last("serial_count"), *map(F.asc_nulls_last, TIE)]
    number = F.row_number().over(Window.partitionBy("device_serial", "event_date").orderBy(*order)).cast("bigint")
    return df.select(
        "event_date", "device_serial", number.alias("point_sequence"), "event_timestamp", F.col("server_timestamp").alias("received_at"), "latitude", "longitude", "speed",
        "direction_degrees", "odometer_trip", "odometer_total", "horimeter", "hdop", "rx_level", "message_type", "report_type", "serial_count", "protocol_version",
        "position_quality", (F.coalesce("speed", F.lit(0.0)) >= MOVING_SPEED).alias("is_moving"), "source_file",
    )


def daily_summary(telemetry: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """29 measures per device and day in one aggregation."""
    df = dedup_telemetry(_within(telemetry, dates, "event_date"))
    when = [F.col("event_timestamp"), *map(F.col, TIE)]
    valid, speed, ts = F.col("has_valid_coordinates"), F.col("speed"), F.col("event_timestamp")
    ends = {f"{edge}_{c}": f(F.when(valid, F.col(c)), *when) for edge, f in (("first", first_by), ("last", last_by)) for c in ("latitude", "longitude")}
    grouped = df.groupBy("event_date", "device_serial").agg(
        F.min(ts).alias("first_event_at"), F.max(ts).alias("last_event_at"), F.count(F.lit(1)).alias("message_count"),
        F.size(F.collect_set("message_type")).cast("bigint").alias("distinct_message_type_count"),
        F.count_if(valid).alias("valid_position_count"), F.count_if(F.coalesce(~valid, F.lit(True))).alias("invalid_position_count"),
        F.count_if(F.col("position_quality") == "LOW_GPS_PRECISION").alias("low_gps_precision_count"),
        F.count_if(speed >= MOVING_SPEED).alias("moving_event_count"), F.count_if(speed < MOVING_SPEED).alias("stopped_event_count"),
        mean_of(speed, 3).alias("average_speed"), mean_of(F.when(speed >= MOVING_SPEED, speed), 3).alias("average_speed_while_moving"), F.max(speed).alias("maximum_speed"),
        mean_of(F.col("hdop"), 3).alias("average_hdop"), F.min("hdop").alias("minimum_hdop"), F.max("hdop").alias("maximum_hdop"),
        F.min("battery_voltage").alias("minimum_battery_voltage"), F.max("battery_voltage").alias("maximum_battery_voltage"), mean_of(F.col("battery_voltage"), 3).alias("average_battery_voltage"),
        F.min("internal_battery").alias("minimum_internal_battery"), F.max("internal_battery").alias("maximum_internal_battery"), mean_of(F.col("internal_battery"), 3).alias("average_internal_battery"),
        first_by(F.col("odometer_total"), *when).alias("first_odometer_total"), last_by(F.col("odometer_total"), *when).alias("last_odometer_total"),
        F.min(F.when(valid, ts)).alias("first_valid_position_at"), F.max(F.when(valid, ts)).alias("last_valid_position_at"), *[c.alias(n) for n, c in ends.items()],
    )
    a, b = F.col("first_odometer_total"), F.col("last_odometer_total")
    share = rounded(F.col("valid_position_count") * F.lit(100.0) / F.nullif(F.col("message_count"), F.lit(0)), 2)
    return grouped.withColumns(
        {"valid_position_percentage": share, "odometer_delta_raw": F.when(b >= a, b - a), "has_odometer_regression": F.coalesce(b < a, F.lit(False))}
    ).select(
        "event_date", "device_serial", "first_event_at", "last_event_at", "message_count", "distinct_message_type_count", "valid_position_count", "invalid_position_count",
        "low_gps_precision_count", "valid_position_percentage", "moving_event_count", "stopped_event_count", "average_speed", "average_speed_while_moving", "maximum_speed",
        "average_hdop", "minimum_hdop", "maximum_hdop", "minimum_battery_voltage", "maximum_battery_voltage", "average_battery_voltage", "minimum_internal_battery",
        "maximum_internal_battery", "average_internal_battery", "first_odometer_total", "last_odometer_total", "odometer_delta_raw", "has_odometer_regression",
        "first_valid_position_at", "last_valid_position_at", "first_latitude", "first_longitude", "last_latitude", "last_longitude",
    )


# fixed values: column of each rejection reason
REASONS = {
    "missing_message_type_count": "MISSING_MESSAGE_TYPE",
    "invalid_message_type_count": "INVALID_MESSAGE_TYPE",
    "invalid_timestamp_count": "MISSING_OR_INVALID_TIMESTAMP",
    "missing_device_serial_count": "MISSING_DEVICE_SERIAL",
    "unknown_rejection_count": "UNKNOWN_REJECTION_REASON",
}


def quality_summary(telemetry: DataFrame, identity: DataFrame, rejected: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Accepted and rejected rows per day, copies included. The three kinds pass one aggregation, so there is no join."""
    kind = lambda df, day, name, reason: df.select(F.coalesce(F.col(day), F.lit("unknown")).alias("metric_date"), F.lit(name).alias("kind"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    rows = kind(telemetry, "event_date", "t", none).unionByName(kind(identity, "event_date", "i", none)).unionByName(kind(rejected, "rejection_date", "r", F.col("rejection_reason")))
    rows = _within(rows, dates, "metric_date")
    n = lambda k: F.count_if(F.col("kind") == k)
    grouped = rows.groupBy("metric_date").agg(
        n("t").alias("telemetry_event_count"), n("i").alias("identity_event_count"), n("r").alias("rejected_event_count"),
        *[F.count_if(F.col("reason") == r).alias(c) for c, r in REASONS.items()],
    )
    accepted = F.col("telemetry_event_count") + F.col("identity_event_count")
    total = accepted + F.col("rejected_event_count")
    return grouped.select(
        "metric_date", "telemetry_event_count", "identity_event_count", accepted.alias("accepted_event_count"), "rejected_event_count", total.alias("total_event_count"),
        rounded(F.col("rejected_event_count") * F.lit(100.0) / F.nullif(total, F.lit(0)), 4).alias("rejection_percentage"), *REASONS,
    )
