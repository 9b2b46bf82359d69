"""Loaded log rows to typed telemetry, device identity and rejections.

Every row lands in exactly one of the three. All steps are projections and
filters over one scan; no step moves data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.casts import full_match, text_or_null, to_double, to_timestamp, to_whole
from fleetloom.functions.plan import computed_once

# fixed values: protocol column, normalised name, final kind (t time, s text, d double, i int, l bigint)
PROTOCOL = [
    ("DATA_SERVIDOR", "server_timestamp", "t"),
    ("TM_STAMP", "device_timestamp", "t"),
    ("TIPO_LOG", "log_type", "s"),
    ("MESS_TYPE", "message_type", "s"),
    ("REPT_TYPE", "report_type", "i"),
    ("PRT_VER", "protocol_version", "s"),
    ("S/N ou IMEI", "device_serial", "serial"),
    ("TERM_STATUS", "terminal_status", "s"),
    ("BAT_VOLT", "battery_voltage", "d"),
    ("LOC_STATUS", "location_status", "slot"),
    ("LAT", "latitude", "d"),
    ("LONT", "longitude", "d"),
    ("SPEED", "speed", "d"),
    ("DIR", "direction_degrees", "d"),
    ("INT_BATT", "internal_battery", "d"),
    ("ODO_TRIP", "odometer_trip", "d"),
    ("ODO_TOTAL", "odometer_total", "d"),
    ("HORIMETER", "horimeter", "d"),
    ("HDOP", "hdop", "d"),
    ("MCC", "mcc", "s"),
    ("MNC", "mnc", "s"),
    ("LAC", "lac", "s"),
    ("CELL_ID", "cell_id", "s"),
    ("RX_LEVEL", "rx_level", "d"),
    ("SER_COUNT", "serial_count", "l"),
    ("TX_TECH", "transmission_technology", "s"),
    ("GRP_MSG", "message_group", "s"),
    ("IO_STATUS", "io_status", "s"),
    ("DRIVER_ID", "driver_id", "s"),
    ("PASS_ID", "passenger_id", "s"),
    ("RPM", "rpm", "d"),
    ("TACHO_SPD", "tachograph_speed", "d"),
    ("TACHO_ODO", "tachograph_odometer", "d"),
    ("TEMP_1", "temperature_1", "d"),
    ("TEMP_2", "temperature_2", "d"),
    ("TEMP_3", "temperature_3", "d"),
    ("TEMP_4", "temperature_4", "d"),
]
LINEAGE = ["source_file", "source_file_hash", "source_row_number", "row_id", "batch_id", "ingested_at", "ingestion_date"]
MESSAGE = "T[0-9]+"
IDENTITY = "T1"
LOW_PRECISION_HDOP = 5


def raw_name(name: str, kind: str) -> str:
    """Columns whose meaning depends on the message keep their text under a raw name."""
    return name if kind in "ts" else f"{name}_raw"


def utc_wall(ts: Column) -> Column:
    """A UTC instant as a time without zone, whatever the session's zone."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(F.unix_micros(ts) / F.lit(1_000_000)).cast("decimal(18,6)"))


def normalize(bronze: DataFrame) -> DataFrame:
    """37 protocol columns renamed, trimmed and emptied to null; times typed; lineage typed."""
    kinds = dict(bronze.dtypes)
    ingested = F.col("ingested_at")
    plain = [
        text_or_null(F.col(f"`{c}`").cast("string")).alias(raw_name(n, k)) for c, n, k in PROTOCOL if k != "t"
    ] + [
        F.col("source_file").cast("string"), F.col("source_file_hash").cast("string"), F.col("source_row_number").cast("bigint"),
        F.col("row_id").cast("string"), F.col("batch_id").cast("string"),
        (utc_wall(ingested) if kinds["ingested_at"] == "timestamp" else ingested.cast("timestamp_ntz")).alias("ingested_at"),
        F.col("ingestion_date").try_cast("date").alias("ingestion_date"),
    ]
    df = bronze.select(*plain, *[F.col(f"`{c}`").cast("string").alias(f"__{n}") for c, n, k in PROTOCOL if k == "t"])
    times = {n: to_timestamp(F.col(f"__{n}")) for _, n, k in PROTOCOL if k == "t"}
    df = computed_once(df, **times)
    return df.select(*[raw_name(n, k) for _, n, k in PROTOCOL], *LINEAGE)


def event_time() -> Column:
    return F.coalesce("device_timestamp", "server_timestamp")


def is_message() -> Column:
    return full_match(F.col("message_type"), MESSAGE)


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def has_valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def position_quality(lat: Column, lon: Column, hdop: Column) -> Column:
    return (
        F.when(lat.isNull() | lon.isNull(), "MISSING")
        .when(~(lat.between(-90, 90) & lon.between(-180, 180)), "INVALID")
        .when(hdop > LOW_PRECISION_HDOP, "LOW_GPS_PRECISION")
        .otherwise("VALID")
    )


def device_serial() -> Column:
    return F.regexp_replace("device_serial_raw", "^M", "")


def telemetry(normalized: DataFrame) -> DataFrame:
    """Messages other than identities, with a time and a serial, typed."""
    typed = {"d": lambda c: to_double(c), "i": lambda c: to_whole(to_double(c), "int"), "l": lambda c: to_whole(to_double(c), "bigint")}
    own = []
    for _, n, k in PROTOCOL:
        if k == "t":
            continue
        source = F.col(raw_name(n, k))
        own.append((device_serial() if k == "serial" else typed[k](source) if k in typed else source).alias(n))
    df = normalized.where(is_message() & (F.col("message_type") != IDENTITY) & event_time().isNotNull() & F.col("device_serial_raw").isNotNull())
    df = df.select(_day(event_time()).alias("event_date"), "server_timestamp", "device_timestamp", event_time().alias("event_timestamp"), *own, *LINEAGE)
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns({"has_valid_coordinates": has_valid_coordinates(lat, lon), "position_quality": position_quality(lat, lon, F.col("hdop"))})


def identity(normalized: DataFrame) -> DataFrame:
    """Identity messages, whose slots hold card and device numbers."""
    flag = lambda c, p: F.coalesce(full_match(F.col(c), p), F.lit(False))
    df = normalized.where((F.col("message_type") == IDENTITY) & event_time().isNotNull() & F.col("device_serial_raw").isNotNull())
    return df.select(
        _day(event_time()).alias("event_date"), "server_timestamp", "device_timestamp", event_time().alias("event_timestamp"), "message_type",
        to_whole(to_double(F.col("report_type_raw")), "int").alias("report_type"), "protocol_version", "device_serial_raw", device_serial().alias("device_serial"),
        F.col("battery_voltage_raw").alias("iccid"), F.col("location_status_raw").alias("identity_auxiliary"), F.col("latitude_raw").alias("imsi"),
        F.col("longitude_raw").alias("imei"), *LINEAGE,
        flag("battery_voltage_raw", "[0-9]{18,22}").alias("has_valid_iccid_format"), flag("latitude_raw", "[0-9]{14,16}").alias("has_valid_imsi_format"),
        flag("longitude_raw", "[0-9]{15}").alias("has_valid_imei_format"),
    )


def rejection_reason() -> Column:
    return (
        F.when(F.col("message_type").isNull(), "MISSING_MESSAGE_TYPE")
        .when(~is_message(), "INVALID_MESSAGE_TYPE")
        .when(event_time().isNull(), "MISSING_OR_INVALID_TIMESTAMP")
        .when(F.col("device_serial_raw").isNull(), "MISSING_DEVICE_SERIAL")
    )


def rejected(normalized: DataFrame) -> DataFrame:
    """Rows of neither kind, with the first reason and the day or ``unknown``."""
    df = normalized.withColumn("rejection_reason", rejection_reason()).where("rejection_reason IS NOT NULL")
    rest = [c for c in df.columns if c != "rejection_reason"]
    return df.select(F.coalesce(_day(event_time()), F.lit("unknown")).alias("rejection_date"), event_time().alias("event_timestamp"), *rest, "rejection_reason")


def affected_dates(normalized: DataFrame, batches: DataFrame) -> DataFrame:
    """(event_date) touched by the batches; ``unknown`` stands for rows without a time."""
    touched = normalized.join(batches.select("batch_id").distinct(), "batch_id", "left_semi")
    return touched.select(F.coalesce(_day(event_time()), F.lit("unknown")).alias("event_date")).distinct()


def bronze_scope(normalized: DataFrame, dates: DataFrame) -> DataFrame:
    """All rows, of any batch, whose day is affected."""
    day = F.coalesce(_day(event_time()), F.lit("unknown"))
    return normalized.withColumn("event_date", day).join(dates.select("event_date").distinct(), "event_date", "left_semi").drop("event_date")


def raw_days(bronze: DataFrame) -> DataFrame:
    """Loaded rows with their day, ``__day``, from the two time columns alone."""
    ts = F.coalesce(to_timestamp(F.col("TM_STAMP").cast("string")), to_timestamp(F.col("DATA_SERVIDOR").cast("string")))
    return computed_once(bronze, __day=F.coalesce(_day(ts), F.lit("unknown")))


def raw_scope(bronze: DataFrame, dates: DataFrame) -> DataFrame:
    """:func:`bronze_scope` before normalising: rows of other days are dropped as texts."""
    wanted = dates.select(F.col("event_date").alias("__day")).distinct()
    return raw_days(bronze).join(wanted, "__day", "left_semi").drop("__day")
