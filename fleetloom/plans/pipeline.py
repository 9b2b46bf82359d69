"""Inbox to curated tables: full, incremental or nothing to do.

Incremental runs rebuild what new batches touch: the typed tables by affected
day from all rows of that day, the day products by day, the device products from
the whole history of affected devices. After any sequence of files the tables
equal those of a full rebuild, except that a device row, once there, stays.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetloom.operators import classify, products
from fleetloom.operators.classify import LINEAGE
from fleetloom.session import together
from fleetloom.sources import inbox, shared
from fleetloom.sources.store import Table

SILVER = {"telemetry_events": "event_date", "device_identity_events": "event_date", "rejected_logs": "rejection_date"}
GOLD = {
    "dim_device": None,
    "device_last_position": None,
    "device_route_points": "event_date",
    "device_daily_summary": "event_date",
    "data_quality_summary": "metric_date",
}


class Lake:
    """The tables under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        at = lambda layer, name: Table(spark, f"{self.root}/{layer}/{name}")
        self.control, self.bronze = at("00_control", "ingestion_files"), at("01_bronze", "tracker_logs")
        self.silver = {n: at("02_silver", n) for n in SILVER}
        self.gold = {n: at("03_gold", n) for n in GOLD}

    def ready(self, tables: dict[str, Table], layout: dict[str, str | None]) -> bool:
        """All tables stand, with the expected string partitions: else one full rebuild is due."""
        for name, column in layout.items():
            if not tables[name].exists():
                return False
            m = tables[name].manifest()
            if m.partition_by != column or (column and not isinstance(m.struct[column].dataType, StringType)):
                return False
        return True


@dataclass(frozen=True)
class SilverResult:
    mode: str
    event_dates: tuple[str, ...] = ()
    rejection_dates: tuple[str, ...] = ()
    rows: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class GoldResult:
    mode: str
    event_dates: tuple[str, ...] = ()
    rejection_dates: tuple[str, ...] = ()
    rows: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineResult:
    status: str
    bronze: inbox.Loaded | None
    silver: SilverResult | None = None
    gold: GoldResult | None = None


def clean(values: Iterable[str] | None) -> tuple[str, ...]:
    """Distinct non-blank texts in order."""
    return tuple(sorted({v.strip() for v in values or () if v and v.strip()}))


def _values(df: DataFrame, column: str) -> tuple[str, ...]:
    """Distinct days of a frame, at most one row per calendar day."""
    return clean(r[0] for r in df.select(column).distinct().collect())


def refresh_silver(lake: Lake, batch_ids: Iterable[str] | None = None) -> SilverResult:
    """None: everything anew. No batch: nothing. Else the days that the batches touch."""
    batches = None if batch_ids is None else clean(batch_ids)
    before = {n: t.manifest().version if t.exists() else None for n, t in lake.silver.items()}
    bronze = lake.bronze.read()
    missing = [c for c in LINEAGE if c not in bronze.columns]
    if missing:
        raise ValueError(f"the loaded table lacks {missing}")
    full = batches is None or not lake.ready(lake.silver, SILVER)
    if not full:
        if not batches:
            return SilverResult("NOOP")
        # a list of batches reaches the scan, whose statistics skip most leaves
        days = _values(classify.raw_days(bronze.where(F.col("batch_id").isin(*batches))), "__day")
        if not days:
            return SilverResult("NOOP")
        bronze = classify.raw_scope(bronze, lake.spark.createDataFrame([(d,) for d in days], "event_date string"))
    normalized = classify.normalize(bronze).persist(StorageLevel.MEMORY_AND_DISK)  # one scan and parse for three tables
    try:
        made = {"telemetry_events": classify.telemetry(normalized), "device_identity_events": classify.identity(normalized), "rejected_logs": classify.rejected(normalized)}

        def write(name: str) -> int:
            table = lake.silver[name]
            m = table.overwrite(made[name], SILVER[name]) if full else table.replace_where(made[name], days, based_on=before[name])
            return m.metrics["rows"]

        rows = together({n: partial(write, n) for n in made})
        if full:
            events = {*lake.silver["telemetry_events"].partitions(), *lake.silver["device_identity_events"].partitions()}
            return SilverResult("FULL", clean(events), clean(lake.silver["rejected_logs"].partitions()), rows)
        return SilverResult("INCREMENTAL", clean(d for d in days if d != "unknown"), days, rows)
    finally:
        normalized.unpersist()


def refresh_gold(lake: Lake, event_dates: Iterable[str] | None = None, rejection_dates: Iterable[str] | None = None) -> GoldResult:
    """No dates given: everything anew. Empty dates: nothing. Else days, and the devices of the event days."""
    asked = event_dates is not None or rejection_dates is not None
    events, rejections = clean(event_dates), clean(rejection_dates)
    if asked and not (events or rejections):
        return GoldResult("NOOP")
    spark = lake.spark
    before = {n: t.manifest().version if t.exists() else None for n, t in lake.gold.items()}
    t, i, r = (lake.silver[n].read() for n in SILVER)
    full = not asked or not lake.ready(lake.gold, GOLD)
    if full:
        made = {
            "dim_device": products.dim_device(t, i),
            "device_last_position": products.last_position(t),
            "device_route_points": products.route_points(t),
            "device_daily_summary": products.daily_summary(t),
            "data_quality_summary": products.quality_summary(t, i, r),
        }
        rows = together({n: lambda n=n: lake.gold[n].overwrite(made[n], GOLD[n]).metrics["rows"] for n in made})
        dates = clean([*lake.silver["telemetry_events"].partitions(), *lake.silver["device_identity_events"].partitions()])
        return GoldResult("FULL", dates, clean(lake.gold["data_quality_summary"].partitions()), rows)
    metric = clean([*events, *rejections])
    # only the leaves of the affected days are opened
    t_days, i_days, r_days = (lake.silver[n].read(partitions=metric) for n in SILVER)
    days = spark.createDataFrame([(d,) for d in events], "event_date string")
    devices = products.affected_devices(t_days, i_days, days)
    t_events = lake.silver["telemetry_events"].read(partitions=events)
    made = {
        "dim_device": products.dim_device(t, i, devices),
        "device_last_position": products.last_position(t, devices),
        "device_route_points": products.route_points(t_events),
        "device_daily_summary": products.daily_summary(t_events),
        "data_quality_summary": products.quality_summary(t_days, i_days, r_days),
    }
    devices_of = {n: lambda n=n: lake.gold[n].merge_upsert(made[n], "device_serial") for n in ("dim_device", "device_last_position")}
    replaced = {"device_route_points": events, "device_daily_summary": events, "data_quality_summary": metric}
    days_of = {n: lambda n=n, days=days: lake.gold[n].replace_where(made[n], days, based_on=before[n]).metrics["rows"] for n, days in replaced.items()}
    rows = together(devices_of | days_of)
    return GoldResult("INCREMENTAL", events, rejections, rows)


def run(lake: Lake, folders: inbox.Folders | shared.Folders, ingested_at: datetime | None = None) -> PipelineResult:
    """Load the inbox, local or shared, and refresh what it touches."""
    source = shared if isinstance(folders, shared.Folders) else inbox
    loaded = source.load(lake.spark, folders, lake.bronze, lake.control, ingested_at)
    if not loaded.batch_ids:
        return PipelineResult("NOOP", loaded)
    silver = refresh_silver(lake, loaded.batch_ids)
    if silver.mode == "NOOP":
        return PipelineResult("SILVER_NOOP", loaded, silver)
    return PipelineResult("SUCCESS", loaded, silver, refresh_gold(lake, silver.event_dates, silver.rejection_dates))


def full_refresh(spark: SparkSession, csv_path: str, out: str, infer: bool = False) -> dict[str, str]:
    """The plain lane: CSV to Parquet folders, all written anew, without a table store; days are dates.

    The loaded rows are a folder of their own, and the name of the file of that folder is a row's
    ``source_file`` unless the CSV has one. ``infer`` types the CSV's columns by their content, by which
    identity numbers in measure columns lose their writing; without it all columns are text.
    """
    reader = spark.read.option("header", True).option("inferSchema", infer).option("escape", '"').option("multiLine", True)
    df = reader.option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(csv_path)  # without a format, "T2" is inferred as a time
    paths = {"tracker_logs": f"{out}/tracker_logs"}
    df.toDF(*[c.strip() for c in df.columns]).write.mode("overwrite").option("compression", "zstd").parquet(paths["tracker_logs"])
    df = spark.read.parquet(paths["tracker_logs"])
    df = df.select("*", F.col("_metadata.file_path").alias("source_file")) if "source_file" not in df.columns else df
    for name in LINEAGE:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("bigint" if name == "source_row_number" else "timestamp" if name == "ingested_at" else "string"))
    normalized = classify.normalize(df)
    typed = {"telemetry_events": classify.telemetry(normalized), "device_identity_events": classify.identity(normalized), "rejected_logs": classify.rejected(normalized)}

    def write(df: DataFrame, name: str, by: str | None) -> DataFrame:
        paths[name] = f"{out}/{name}"
        for day in {"event_date", "last_position_date"} & set(df.columns):
            df = df.withColumn(day, F.col(day).try_cast("date"))
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(paths[name])
        # union by name over all partitions, with the types that were written
        return spark.read.schema(df.schema).parquet(paths[name])

    def texts(df: DataFrame) -> DataFrame:
        return df.withColumn("event_date", F.col("event_date").cast("string")) if "event_date" in df.columns else df

    t, i, r = (texts(write(typed[n], n, SILVER[n])) for n in SILVER)
    write(products.dim_device(t, i), "dim_device", None)
    write(products.last_position(t), "device_last_position", None)
    write(products.daily_summary(t), "device_daily_summary", "event_date")
    write(products.quality_summary(t, i, r), "data_quality_summary", "metric_date")
    return paths
