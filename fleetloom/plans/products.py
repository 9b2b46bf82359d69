"""Queries of the pipeline's own operators on the loaded logs, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators import classify, products
from fleetloom.operators.classify import LINEAGE, PROTOCOL, raw_name
from fleetloom.plans import service
from fleetloom.session import shared_dir
from fleetloom.sources.store import Table


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/tracker_logs.parquet")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.normalize(logs(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.telemetry(normalized(spark, sf_dir))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.identity(normalized(spark, sf_dir))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.rejected(normalized(spark, sf_dir))


def classification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per class; their sum is the number of rows."""
    df = normalized(spark, sf_dir)
    kind = F.coalesce(classify.rejection_reason(), F.when(F.col("message_type") == classify.IDENTITY, "identity").otherwise("telemetry"))
    return df.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("row_count"))


def _last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = logs(spark, sf_dir).groupBy("batch_id").agg(F.max("ingested_at").alias("at"))
    return df.orderBy(F.desc("at"), "batch_id").limit(1).select("batch_id")


def affected_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the newest batch touches."""
    return classify.affected_dates(normalized(spark, sf_dir), _last_batch(spark, sf_dir))


def bronze_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of those days, whatever their batch."""
    return classify.bronze_scope(normalized(spark, sf_dir), affected_dates(spark, sf_dir)).select("batch_id", "row_id", "message_type", "device_serial_raw")


def affected_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalized(spark, sf_dir)
    return products.affected_devices(classify.telemetry(df), classify.identity(df), affected_dates(spark, sf_dir))


def dedup_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.dedup_telemetry(telemetry(spark, sf_dir))


def dedup_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.dedup_identity(identity(spark, sf_dir))


def dim_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalized(spark, sf_dir)
    return products.dim_device(classify.telemetry(df), classify.identity(df))


def last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.last_position(telemetry(spark, sf_dir))


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.route_points(telemetry(spark, sf_dir))


def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.daily_summary(telemetry(spark, sf_dir))


def daily_summary_of_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily product from the stored telemetry table."""
    return products.daily_summary(spark.read.parquet(f"{sf_dir}/telemetry_events.parquet"))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalized(spark, sf_dir)
    return products.quality_summary(classify.telemetry(df), classify.identity(df), classify.rejected(df))


def file_row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids recomputed from file hash and row number, where they differ from the stored ones: none."""
    df = logs(spark, sf_dir)
    own = F.sha2(F.concat_ws(":", "source_file_hash", F.col("source_row_number").cast("string")), 256)
    return df.select("row_id", own.alias("computed_id")).where("row_id IS NULL OR row_id <> computed_id")


def hash_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the control log calls loaded and that the table holds."""
    control = spark.read.parquet(f"{sf_dir}/ingestion_files.parquet").where("status = 'SUCCESS'").select("source_file_hash")
    return control.intersect(logs(spark, sf_dir).select("source_file_hash"))


def _stored(spark: SparkSession) -> Table:
    """A new table of the store in the folder that executors share."""
    return Table(spark, f"{shared_dir(spark)}/stored/{uuid.uuid4().hex}")


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table before its newest batch, and that batch."""
    df, last = logs(spark, sf_dir), _last_batch(spark, sf_dir)
    return df.join(last, "batch_id", "left_anti"), df.join(last, "batch_id", "left_semi")


def insert_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per batch of a stored table after inserting what the newest batch adds by row id."""
    old, new = _splits(spark, sf_dir)
    table = _stored(spark)
    table.append(old, "ingestion_date")
    table.merge_insert(new, "row_id", "ingestion_date")
    return table.read().groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored last positions before the newest batch, updated by that batch's devices."""
    old, new = (products.last_position(classify.telemetry(classify.normalize(x))) for x in _splits(spark, sf_dir))
    table = _stored(spark)
    table.overwrite(old)
    table.merge_upsert(new, "device_serial")
    return table.read()


def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored daily summaries without the newest batch, its days replaced by full recomputation."""
    old, _ = _splits(spark, sf_dir)
    table = _stored(spark)
    table.overwrite(products.daily_summary(classify.telemetry(classify.normalize(old))), "event_date")
    days = [r[0] for r in affected_dates(spark, sf_dir).collect()]  # a row per day
    scope = spark.createDataFrame([(d,) for d in days], "event_date string")
    table.replace_where(products.daily_summary(telemetry(spark, sf_dir), scope), days, based_on=0)
    return table.read()


def batch_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and files of each batch."""
    return logs(spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("source_file").alias("file_count"))


def api_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts per normalised day, from the stored summaries of all loads."""
    return service.quality_rows(spark.read.parquet(f"{sf_dir}/data_quality_summary.parquet"))


def api_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries of a period."""
    return service.daily_rows(daily_summary_of_silver(spark, sf_dir), date(2025, 2, 1), date(2025, 2, 14)).select("event_date", "device_serial", "message_count", "maximum_speed")


def api_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every device's plottable points of a day."""
    return service.route_statistics(service.route_rows(spark.read.parquet(f"{sf_dir}/device_route_points.parquet"), date(2025, 2, 1)))


def api_daily_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries without a period."""
    return service.daily_rows(daily_summary_of_silver(spark, sf_dir)).select("event_date", "device_serial", "message_count", "maximum_speed")


def api_route_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every device's plottable points of each day."""
    return service.route_statistics(service.route_rows(spark.read.parquet(f"{sf_dir}/device_route_points.parquet"), None))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize": normalized,
    "telemetry_events": telemetry,
    "identity_events": identity,
    "rejected_logs": rejected,
    "classification_counts": classification_counts,
    "affected_dates": affected_dates,
    "bronze_scope": bronze_scope,
    "affected_devices": affected_devices,
    "dedup_telemetry": dedup_telemetry,
    "dedup_identity": dedup_identity,
    "dim_device": dim_device,
    "last_position": last_position,
    "route_points": route_points,
    "daily_summary": daily_summary,
    "daily_summary_of_silver": daily_summary_of_silver,
    "quality_summary": quality_summary,
    "file_row_hash": file_row_hash,
    "hash_intersection": hash_intersection,
    "insert_only_merge": insert_only_merge,
    "upsert_merge": upsert_merge,
    "replace_partition": replace_partition,
    "batch_confirmation": batch_confirmation,
    "api_quality": api_quality,
    "api_daily": api_daily,
    "api_route": api_route,
    "api_daily_all": api_daily_all,
    "api_route_all": api_route_all,
}

# --- SQL -----------------------------------------------------------------

_TEXTS = ", ".join(f"""NULLIF(TRIM("{c}"), '') AS {raw_name(n, k)}""" for c, n, k in PROTOCOL if k != "t")
_TIMES = ", ".join(f'TRY_CAST("{c}" AS TIMESTAMP) AS {n}' for c, n, k in PROTOCOL if k == "t")
_LINEAGE = "source_file, source_file_hash, source_row_number, row_id, batch_id, ingested_at AT TIME ZONE 'UTC' AS ingested_at, TRY_CAST(ingestion_date AS DATE) AS ingestion_date"
_TYPED = {"d": "TRY_CAST({} AS DOUBLE)", "i": "TRY_CAST(TRY_CAST({} AS DOUBLE) AS INTEGER)", "l": "TRY_CAST(TRY_CAST({} AS DOUBLE) AS BIGINT)", "serial": "regexp_replace({}, '^M', '')"}
_OWN = ", ".join(_TYPED.get(k, "{}").format(raw_name(n, k)) + f" AS {n}" for _, n, k in PROTOCOL if k != "t")
_ALL = ", ".join(LINEAGE)
_ROWS = ", ".join(raw_name(n, k) for _, n, k in PROTOCOL)


def _with(source: str = "tracker_logs", suffix: str = "") -> str:
    """Common table expressions of the typed tables over a table of logs."""
    s = suffix
    return f"""
normalized{s} AS (SELECT {_TIMES}, {_TEXTS}, {_LINEAGE} FROM {source}),
timed{s} AS (SELECT *, coalesce(device_timestamp, server_timestamp) AS event_timestamp, regexp_full_match(message_type, 'T[0-9]+') AS is_message FROM normalized{s}),
telemetry{s} AS (
  SELECT *, coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS has_valid_coordinates,
    CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'MISSING' WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'INVALID'
      WHEN hdop > 5 THEN 'LOW_GPS_PRECISION' ELSE 'VALID' END AS position_quality
  FROM (SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_date, server_timestamp, device_timestamp, event_timestamp, {_OWN}, {_ALL}
    FROM timed{s} WHERE is_message AND message_type <> 'T1' AND event_timestamp IS NOT NULL AND device_serial_raw IS NOT NULL)),
identities{s} AS (
  SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_date, server_timestamp, device_timestamp, event_timestamp, message_type,
    TRY_CAST(TRY_CAST(report_type_raw AS DOUBLE) AS INTEGER) AS report_type, protocol_version, device_serial_raw, regexp_replace(device_serial_raw, '^M', '') AS device_serial,
    battery_voltage_raw AS iccid, location_status_raw AS identity_auxiliary, latitude_raw AS imsi, longitude_raw AS imei, {_ALL},
    coalesce(regexp_full_match(battery_voltage_raw, '[0-9]{{18,22}}'), false) AS has_valid_iccid_format,
    coalesce(regexp_full_match(latitude_raw, '[0-9]{{14,16}}'), false) AS has_valid_imsi_format, coalesce(regexp_full_match(longitude_raw, '[0-9]{{15}}'), false) AS has_valid_imei_format
  FROM timed{s} WHERE message_type = 'T1' AND event_timestamp IS NOT NULL AND device_serial_raw IS NOT NULL),
reasoned{s} AS (
  SELECT *, CASE WHEN message_type IS NULL THEN 'MISSING_MESSAGE_TYPE' WHEN NOT is_message THEN 'INVALID_MESSAGE_TYPE'
    WHEN event_timestamp IS NULL THEN 'MISSING_OR_INVALID_TIMESTAMP' WHEN device_serial_raw IS NULL THEN 'MISSING_DEVICE_SERIAL' END AS rejection_reason FROM timed{s}),
rejected{s} AS (
  SELECT coalesce(strftime(event_timestamp, '%Y-%m-%d'), 'unknown') AS rejection_date, event_timestamp, {_ROWS}, {_ALL}, rejection_reason
  FROM reasoned{s} WHERE rejection_reason IS NOT NULL),
{_dedup('telemetry' + s, 'unique_telemetry' + s)},
unique_identities{s} AS (
  SELECT * FROM identities{s} WHERE device_serial IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY device_serial, event_timestamp, imei, imsi, iccid
    ORDER BY server_timestamp DESC NULLS LAST, source_file DESC NULLS LAST, row_id DESC NULLS LAST, batch_id DESC NULLS LAST) = 1)"""


def _dedup(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT * FROM {source} WHERE device_serial IS NOT NULL AND event_timestamp IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY device_serial, event_timestamp, message_type, serial_count, CAST(latitude AS VARCHAR), CAST(longitude AS VARCHAR), CAST(speed AS VARCHAR)
    ORDER BY server_timestamp DESC NULLS LAST, source_file DESC NULLS LAST, row_id DESC NULLS LAST, batch_id DESC NULLS LAST) = 1)"""


_DAYS = """
newest AS (SELECT batch_id FROM tracker_logs GROUP BY batch_id ORDER BY max(ingested_at) DESC, batch_id LIMIT 1),
days AS (SELECT DISTINCT coalesce(strftime(event_timestamp, '%Y-%m-%d'), 'unknown') AS event_date FROM timed WHERE batch_id IN (FROM newest))"""


def _edge(f: str, column: str, when: str = "true") -> str:
    return f"{f}({column}, (event_timestamp, row_id, batch_id)) FILTER ({when} AND {column} IS NOT NULL)"


def _mean(column: str, when: str = "true") -> str:
    return (
        f"round(CAST(sum(TRY_CAST({column} AS DECIMAL(28,6))) FILTER ({when}) AS DOUBLE) / nullif(count({column}) FILTER ({when}), 0), 3)"
    )


def _daily(source: str) -> str:
    valid = "has_valid_coordinates"
    return f"""
SELECT *, round(valid_position_count * 100.0 / nullif(message_count, 0), 2)::DOUBLE AS valid_position_percentage,
  CASE WHEN last_odometer_total >= first_odometer_total THEN last_odometer_total - first_odometer_total END AS odometer_delta_raw,
  coalesce(last_odometer_total < first_odometer_total, false) AS has_odometer_regression
FROM (
  SELECT event_date, device_serial, min(event_timestamp) AS first_event_at, max(event_timestamp) AS last_event_at, count(*) AS message_count,
    count(DISTINCT message_type) AS distinct_message_type_count, count(*) FILTER ({valid}) AS valid_position_count, count(*) FILTER ({valid} IS NOT TRUE) AS invalid_position_count,
    count(*) FILTER (position_quality = 'LOW_GPS_PRECISION') AS low_gps_precision_count, count(*) FILTER (speed >= 5) AS moving_event_count, count(*) FILTER (speed < 5) AS stopped_event_count,
    {_mean("speed")} AS average_speed, {_mean("speed", "speed >= 5")} AS average_speed_while_moving, max(speed) AS maximum_speed,
    {_mean("hdop")} AS average_hdop, min(hdop) AS minimum_hdop, max(hdop) AS maximum_hdop,
    min(battery_voltage) AS minimum_battery_voltage, max(battery_voltage) AS maximum_battery_voltage, {_mean("battery_voltage")} AS average_battery_voltage,
    min(internal_battery) AS minimum_internal_battery, max(internal_battery) AS maximum_internal_battery, {_mean("internal_battery")} AS average_internal_battery,
    {_edge("arg_min", "odometer_total")} AS first_odometer_total, {_edge("arg_max", "odometer_total")} AS last_odometer_total,
    min(event_timestamp) FILTER ({valid}) AS first_valid_position_at, max(event_timestamp) FILTER ({valid}) AS last_valid_position_at,
    {_edge("arg_min", "latitude", valid)} AS first_latitude, {_edge("arg_min", "longitude", valid)} AS first_longitude,
    {_edge("arg_max", "latitude", valid)} AS last_latitude, {_edge("arg_max", "longitude", valid)} AS last_longitude
  FROM {source} GROUP BY event_date, device_serial)"""


def _positions(source: str) -> str:
    return f"""
SELECT device_serial, strftime(event_timestamp, '%Y-%m-%d') AS last_position_date, event_timestamp AS last_position_at, server_timestamp AS received_at, latitude, longitude, speed,
  direction_degrees, battery_voltage, internal_battery, odometer_total, horimeter, hdop, rx_level, message_type, report_type, serial_count, protocol_version, position_quality, source_file
FROM {source} WHERE has_valid_coordinates AND NOT (latitude = 0 AND longitude = 0)
QUALIFY row_number() OVER (PARTITION BY device_serial ORDER BY event_timestamp DESC, server_timestamp DESC NULLS LAST, serial_count DESC NULLS LAST, row_id DESC, batch_id DESC) = 1"""


_OF_IDENTITY = "of_identity"
_SQL_TAIL = {
    "normalize": f"SELECT {_ROWS}, {_ALL} FROM normalized",
    "telemetry_events": "SELECT * FROM telemetry",
    "identity_events": "SELECT * FROM identities",
    "rejected_logs": "SELECT * FROM rejected",
    "classification_counts": "SELECT coalesce(rejection_reason, CASE WHEN message_type = 'T1' THEN 'identity' ELSE 'telemetry' END) AS class, count(*) AS row_count FROM reasoned GROUP BY ALL",
    "dedup_telemetry": "SELECT * FROM unique_telemetry",
    "dedup_identity": "SELECT * FROM unique_identities",
    "last_position": _positions("unique_telemetry"),
    "route_points": """
SELECT event_date, device_serial,
  row_number() OVER (PARTITION BY device_serial, event_date ORDER BY event_timestamp, server_timestamp NULLS LAST, serial_count NULLS LAST, row_id NULLS LAST, batch_id NULLS LAST) AS point_sequence,
  event_timestamp, server_timestamp AS received_at, latitude, longitude, speed, direction_degrees, odometer_trip, odometer_total, horimeter, hdop, rx_level, message_type, report_type,
  serial_count, protocol_version, position_quality, coalesce(speed, 0) >= 5 AS is_moving, source_file
FROM unique_telemetry WHERE has_valid_coordinates AND NOT (latitude = 0 AND longitude = 0)""",
    "daily_summary": _daily("unique_telemetry"),
    "dim_device": f"""
SELECT device_serial, {_edge("arg_max", "imei", _OF_IDENTITY)} AS current_imei, {_edge("arg_max", "imsi", _OF_IDENTITY)} AS current_imsi, {_edge("arg_max", "iccid", _OF_IDENTITY)} AS current_iccid,
  {_edge("arg_max", "identity_auxiliary", _OF_IDENTITY)} AS current_identity_auxiliary,
  coalesce({_edge("arg_max", "protocol_version", _OF_IDENTITY)}, {_edge("arg_max", "protocol_version", "NOT of_identity")}) AS current_protocol_version,
  min(event_timestamp) AS first_seen_at, max(event_timestamp) AS last_seen_at, min(event_timestamp) FILTER (of_identity) AS first_identity_at, max(event_timestamp) FILTER (of_identity) AS last_identity_at,
  min(event_timestamp) FILTER (NOT of_identity) AS first_telemetry_at, max(event_timestamp) FILTER (NOT of_identity) AS last_telemetry_at,
  count(*) FILTER (of_identity) AS identity_event_count, count(*) FILTER (NOT of_identity) AS telemetry_event_count, bool_or(of_identity) AS has_identity_event, bool_or(NOT of_identity) AS has_telemetry_event,
  {_edge("arg_max", "has_valid_imei_format", _OF_IDENTITY)} AS current_imei_format_valid, {_edge("arg_max", "has_valid_imsi_format", _OF_IDENTITY)} AS current_imsi_format_valid,
  {_edge("arg_max", "has_valid_iccid_format", _OF_IDENTITY)} AS current_iccid_format_valid
FROM (SELECT *, true AS of_identity FROM unique_identities UNION ALL BY NAME SELECT device_serial, event_timestamp, row_id, batch_id, protocol_version, false AS of_identity FROM unique_telemetry)
GROUP BY device_serial""",
    "quality_summary": """
SELECT metric_date, count(*) FILTER (kind = 'telemetry') AS telemetry_event_count, count(*) FILTER (kind = 'identity') AS identity_event_count, count(*) FILTER (kind <> 'rejected') AS accepted_event_count,
  count(*) FILTER (kind = 'rejected') AS rejected_event_count, count(*) AS total_event_count, round(count(*) FILTER (kind = 'rejected') * 100.0 / count(*), 4)::DOUBLE AS rejection_percentage,
  count(*) FILTER (reason = 'MISSING_MESSAGE_TYPE') AS missing_message_type_count, count(*) FILTER (reason = 'INVALID_MESSAGE_TYPE') AS invalid_message_type_count,
  count(*) FILTER (reason = 'MISSING_OR_INVALID_TIMESTAMP') AS invalid_timestamp_count, count(*) FILTER (reason = 'MISSING_DEVICE_SERIAL') AS missing_device_serial_count, CAST(0 AS BIGINT) AS unknown_rejection_count
FROM (
  SELECT event_date AS metric_date, 'telemetry' AS kind, NULL AS reason FROM telemetry UNION ALL SELECT event_date, 'identity', NULL FROM identities
  UNION ALL SELECT rejection_date, 'rejected', rejection_reason FROM rejected)
GROUP BY metric_date""",
}
_SQL_DAYS = {
    "affected_dates": "SELECT event_date FROM days",
    "bronze_scope": "SELECT batch_id, row_id, message_type, device_serial_raw FROM timed WHERE coalesce(strftime(event_timestamp, '%Y-%m-%d'), 'unknown') IN (FROM days)",
    "affected_devices": """SELECT device_serial FROM unique_telemetry WHERE event_date IN (FROM days) UNION SELECT device_serial FROM unique_identities WHERE event_date IN (FROM days)""",
}
_SPLIT = "WITH newest AS (SELECT batch_id FROM tracker_logs GROUP BY batch_id ORDER BY max(ingested_at) DESC, batch_id LIMIT 1), old AS (SELECT * FROM tracker_logs WHERE batch_id NOT IN (FROM newest)), new AS (SELECT * FROM tracker_logs WHERE batch_id IN (FROM newest))"
SQL: dict[str, str] = (
    {k: f"WITH {_with()} {s}" for k, s in _SQL_TAIL.items()}
    | {k: f"WITH {_with()}, {_DAYS} {s}" for k, s in _SQL_DAYS.items()}
    | {
        "daily_summary_of_silver": f"WITH {_dedup('telemetry_events', 'unique_telemetry')} {_daily('unique_telemetry')}",
        "file_row_hash": "SELECT row_id, computed_id FROM (SELECT row_id, sha256(source_file_hash || ':' || source_row_number) AS computed_id FROM tracker_logs) WHERE row_id IS NULL OR row_id <> computed_id",
        "hash_intersection": "SELECT source_file_hash FROM ingestion_files WHERE status = 'SUCCESS' INTERSECT SELECT source_file_hash FROM tracker_logs",
        "insert_only_merge": f"{_SPLIT} SELECT batch_id, count(*) AS row_count FROM (SELECT batch_id FROM old UNION ALL (SELECT DISTINCT ON (row_id) batch_id FROM new WHERE row_id NOT IN (SELECT row_id FROM old))) GROUP BY batch_id",
        "upsert_merge": f"{_SPLIT}, {_with('old', '_old')}, {_with('new', '_new')}, before AS ({_positions('unique_telemetry_old')}), after AS ({_positions('unique_telemetry_new')}) SELECT * FROM before WHERE device_serial NOT IN (SELECT device_serial FROM after) UNION ALL SELECT * FROM after",
        "batch_confirmation": "SELECT batch_id, count(*) AS row_count, count(DISTINCT source_file) AS file_count FROM tracker_logs GROUP BY batch_id",
    }
)
_COUNTS = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in service.COUNTS)
SQL |= {
    "api_quality": f"""
SELECT *, accepted_event_count + rejected_event_count AS total_event_count,
  CASE WHEN accepted_event_count + rejected_event_count > 0 THEN round_even(rejected_event_count::DOUBLE / (accepted_event_count + rejected_event_count) * 100, 4) ELSE 0.0::DOUBLE END AS rejection_percentage
FROM (SELECT coalesce(CASE WHEN regexp_full_match(metric_date, '\\s*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?\\s*') THEN strftime(TRY_CAST(metric_date AS TIMESTAMP), '%Y-%m-%d') END, 'unknown') AS metric_date, {_COUNTS}
  FROM data_quality_summary GROUP BY 1)""",
    "api_daily": f"WITH {_dedup('telemetry_events', 'unique_telemetry')} SELECT event_date, device_serial, count(*) AS message_count, max(speed) AS maximum_speed FROM unique_telemetry WHERE event_date BETWEEN '2025-02-01' AND '2025-02-14' GROUP BY ALL",
    "api_route": """
SELECT event_date, device_serial, count(*) AS point_count, arg_min(event_timestamp, point_sequence) AS start_at, arg_max(event_timestamp, point_sequence) AS end_at, max(speed) AS maximum_speed
FROM device_route_points WHERE event_date = '2025-02-01' AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) GROUP BY ALL""",
}
# after replacing the days of the newest batch, the table is that of a full rebuild
SQL["replace_partition"] = SQL["daily_summary"]
