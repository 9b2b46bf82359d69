"""Structured Streaming over arriving log rows.

The batch operators are the stream's too: each micro-batch is a load. Event-time
totals use Spark's own watermark, with the same cut-off as the batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fleetloom.operators import classify
from fleetloom.plans.pipeline import Lake, refresh_gold, refresh_silver


def log_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def load_stream(lake: Lake, rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Insert arriving rows by row id and refresh what they touch.

    A micro-batch that runs again after a failure inserts nothing twice and
    refreshes the same days, so its effects are those of one run.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            ids = [r[0] for r in batch.select("batch_id").distinct().collect()]  # a load or a few per micro-batch
            if not ids:
                return
            lake.bronze.merge_insert(batch, "row_id", "ingestion_date")
            silver = refresh_silver(lake, ids)
            if silver.mode != "NOOP":
                refresh_gold(lake, silver.event_dates, silver.rejection_dates)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(rows: DataFrame, cutoff: str = "7 days") -> DataFrame:
    """Messages per device and day of a stream of log rows, closed by the watermark."""
    df = classify.normalize(rows).withColumn("event_time", F.coalesce("device_timestamp", "server_timestamp").cast("timestamp"))
    df = df.where(classify.is_message() & F.col("event_time").isNotNull() & F.col("device_serial_raw").isNotNull())
    return (
        df.withWatermark("event_time", cutoff)
        .groupBy(F.window("event_time", "1 day").alias("day"), classify.device_serial().alias("device_serial"))
        .agg(F.count(F.lit(1)).alias("message_count"))
        .select(F.date_format("day.start", "yyyy-MM-dd").alias("event_date"), "device_serial", "message_count")
    )
