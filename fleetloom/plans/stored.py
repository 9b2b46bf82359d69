"""Queries whose rows come out of the table store, with their SQL twins.

Each takes the loads before the newest one as a stored table, applies one operation
of the store with the newest load and reads the table back as a whole. The ``lake_``
queries read the tables of a pipeline that was built without the newest load and then
refreshed incrementally; their twins compute the same tables from all rows at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.plans import pipeline
from fleetloom.plans.products import _DAYS, _SPLIT, _SQL_TAIL, _daily, _dedup, _splits, _stored, _with, affected_dates, daily_summary, logs
from fleetloom.session import shared_dir
from fleetloom.sources import inbox, shared
from fleetloom.sources.store import Files

#: Loaded columns that the twins compare; the load time travels as microseconds.
KEPT = ("batch_id", "row_id", "source_file", "source_file_hash", "source_row_number", "ingestion_date", "TM_STAMP", "DATA_SERVIDOR", "MESS_TYPE", "LAT", "LONT", "SER_COUNT")
LAKES: dict[tuple[str, str], object] = {}


def _kept(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in KEPT], F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("ingested_us"))


def merged(spark: SparkSession, sf_dir: str) -> Table:
    """The loads before the newest, with the newest inserted by row id."""
    old, new = _splits(spark, sf_dir)
    table = _stored(spark)
    table.append(old, "ingestion_date")
    table.merge_insert(new, "row_id", "ingestion_date")
    return table


def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored row after the insert."""
    return _kept(merged(spark, sf_dir).read())


def store_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the first and the last day of loading, from their partitions alone."""
    table = merged(spark, sf_dir)
    days = table.partitions()
    return _kept(table.read(partitions={days[0], days[-1]}))


def store_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per load in the version before the insert."""
    return merged(spark, sf_dir).read(version=0).groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"))


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries after the days of the newest load are deleted."""
    table = _stored(spark)
    table.overwrite(daily_summary(spark, sf_dir), "event_date")
    table.delete_where(r[0] for r in affected_dates(spark, sf_dir).collect())  # a row per day
    return table.read()


def store_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per day and class after a table of other columns is overwritten."""
    table = _stored(spark)
    table.append(logs(spark, sf_dir).select("ingestion_date", "row_id"), "ingestion_date")
    table.overwrite(logs(spark, sf_dir).groupBy("ingestion_date", "MESS_TYPE").agg(F.count(F.lit(1)).alias("row_count")), "ingestion_date")
    return table.read()


def store_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the newest load with all columns beside older ones that lack two of them."""
    old, new = _splits(spark, sf_dir)
    table = _stored(spark)
    table.append(old.drop("LAT", "LONT"), "ingestion_date")
    table.append(new)
    return _kept(table.read())


def lake(spark: SparkSession, sf_dir: str) -> pipeline.Lake:
    """A pipeline built from the loads before the newest and refreshed with it, once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in LAKES:
        made = pipeline.Lake(spark, f"{shared_dir(spark)}/lake/{uuid.uuid4().hex}")
        old, new = _splits(spark, sf_dir)
        made.bronze.append(old, "ingestion_date")
        pipeline.refresh_silver(made)
        pipeline.refresh_gold(made)
        made.bronze.merge_insert(new, "row_id", "ingestion_date")
        silver = pipeline.refresh_silver(made, [r[0] for r in new.select("batch_id").distinct().collect()])
        pipeline.refresh_gold(made, silver.event_dates, silver.rejection_dates)
        LAKES[key] = made
    return LAKES[key]


def plain(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Folders of the plain lane, from the logs as CSV, once per application and input."""
    key = (spark.sparkContext.applicationId, f"plain {sf_dir}")
    if key not in LAKES:
        folder = f"{shared_dir(spark)}/plain/{uuid.uuid4().hex}"
        kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        logs(spark, sf_dir).write.options(**kept).csv(f"{folder}/csv")
        LAKES[key] = pipeline.full_refresh(spark, f"{folder}/csv", f"{folder}/out")
    return LAKES[key]


def plain_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain lane's daily product, whose days are dates."""
    return spark.read.parquet(plain(spark, sf_dir)["device_daily_summary"]).withColumn("event_date", F.col("event_date").cast("date"))


def plain_last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(plain(spark, sf_dir)["device_last_position"])


def inbox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the logs offered as CSV in a shared inbox, and what the loaded table holds of it."""
    root = f"{shared_dir(spark)}/inbox/{uuid.uuid4().hex}"
    raw = [f"`{c}`" for c in inbox.REQUIRED]
    rows = logs(spark, sf_dir).dropDuplicates(["row_id"]).select("source_file_hash", "source_row_number", *raw)
    rows = rows.repartition("source_file_hash").sortWithinPartitions("source_file_hash", "source_row_number").drop("source_row_number")
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**kept).partitionBy("source_file_hash").csv(f"{root}/made")
    folders, files = shared.Folders.under(spark, root), Files(spark)
    for name in files.names(f"{root}/made"):  # a name per file
        if name.startswith("source_file_hash="):
            part = next(n for n in files.names(f"{root}/made/{name}") if n.endswith(".csv"))
            files.rename(f"{root}/made/{name}/{part}", f"{folders.inbox}/{name.partition('=')[2]}.csv")
    made = pipeline.Lake(spark, f"{root}/lake")
    shared.load(spark, folders, made.bronze, made.control)
    return made.bronze.read().select("source_file", "source_row_number", *raw)


def _of_lake(layer: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(lake(spark, sf_dir), layer)[name].read()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "store_rows": store_rows, "store_partition": store_partition, "store_version": store_version, "store_delete": store_delete, "store_overwrite": store_overwrite, "store_evolved": store_evolved,
    "inbox_rows": inbox_rows, "plain_daily_summary": plain_daily_summary, "plain_last_position": plain_last_position,
    "lake_bronze": lambda spark, sf_dir: _kept(lake(spark, sf_dir).bronze.read()),
    "lake_telemetry": _of_lake("silver", "telemetry_events"), "lake_identity": _of_lake("silver", "device_identity_events"), "lake_rejected": _of_lake("silver", "rejected_logs"),
    "lake_dim_device": _of_lake("gold", "dim_device"), "lake_last_position": _of_lake("gold", "device_last_position"), "lake_route_points": _of_lake("gold", "device_route_points"),
    "lake_daily_summary": _of_lake("gold", "device_daily_summary"), "lake_quality_summary": _of_lake("gold", "data_quality_summary"),
}

# --- SQL -----------------------------------------------------------------

_COLUMNS = ", ".join(f'"{c}"' for c in KEPT) + ", epoch_us(ingested_at) AS ingested_us"
_STORED = f"{_SPLIT}, stored AS (SELECT * FROM old UNION ALL SELECT * FROM new WHERE row_id NOT IN (SELECT row_id FROM old WHERE row_id IS NOT NULL))"
_LAKE = {
    "lake_telemetry": "telemetry_events", "lake_identity": "identity_events", "lake_rejected": "rejected_logs", "lake_dim_device": "dim_device", "lake_last_position": "last_position",
    "lake_route_points": "route_points", "lake_daily_summary": "daily_summary", "lake_quality_summary": "quality_summary",
}
SQL: dict[str, str] = {
    "store_rows": f"{_STORED} SELECT {_COLUMNS} FROM stored",
    "lake_bronze": f"{_STORED} SELECT {_COLUMNS} FROM stored",
    "store_partition": f"{_STORED} SELECT {_COLUMNS} FROM stored WHERE ingestion_date IN (SELECT min(ingestion_date) FROM stored UNION SELECT max(ingestion_date) FROM stored)",
    "inbox_rows": f"""SELECT source_file_hash || '.csv' AS source_file, row_number() OVER (PARTITION BY source_file_hash ORDER BY source_row_number) AS source_row_number, {', '.join(f"coalesce({chr(34)}{c}{chr(34)}, '') AS {chr(34)}{c}{chr(34)}" for c in inbox.REQUIRED)}
FROM (SELECT DISTINCT ON (row_id) * FROM tracker_logs)""",
    "plain_daily_summary": f"WITH {_with()} SELECT * REPLACE (CAST(event_date AS DATE) AS event_date) FROM ({_SQL_TAIL['daily_summary']})",
    "plain_last_position": f"WITH {_with()} SELECT * REPLACE (CAST(last_position_date AS DATE) AS last_position_date) FROM ({_SQL_TAIL['last_position']})",
    "store_version": f"{_SPLIT} SELECT batch_id, count(*) AS row_count FROM old GROUP BY batch_id",
    "store_delete": f"WITH {_with()}, {_DAYS} SELECT * FROM ({_daily('unique_telemetry')}) WHERE event_date NOT IN (FROM days)",
    "store_overwrite": 'SELECT ingestion_date, "MESS_TYPE", count(*) AS row_count FROM tracker_logs GROUP BY ALL',
    "store_evolved": f"{_SPLIT} SELECT {_COLUMNS} FROM (SELECT * REPLACE (NULL AS \"LAT\", NULL AS \"LONT\") FROM old UNION ALL SELECT * FROM new)",
} | {k: f"{_STORED}, {_with('stored')} {_SQL_TAIL[t]}" for k, t in _LAKE.items()}
# the read service's queries without a period, which are registered with the products
SQL |= {
    "api_daily_all": f"WITH {_dedup('telemetry_events', 'unique_telemetry')} SELECT event_date, device_serial, count(*) AS message_count, max(speed) AS maximum_speed FROM unique_telemetry GROUP BY ALL",
    "api_route_all": """
SELECT event_date, device_serial, count(*) AS point_count, arg_min(event_timestamp, point_sequence) AS start_at, arg_max(event_timestamp, point_sequence) AS end_at, max(speed) AS maximum_speed
FROM device_route_points WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) GROUP BY ALL""",
}
