"""Event-time totals under late and out-of-order records (problem 4).

Each load of a source carries a punctuation: after it, the source promises
nothing older than the load's date less the lateness. A source's low watermark
is the greatest such bound; the watermark of the table is the least over all
sources that are not idle, and never falls. A period closes once the table's
watermark passes it. A record is diverted (``dropped``) if at its load its period
lies behind its own source's watermark, or is closed; one that is late but before
both corrects the period's total. So no record counts for a period after its close.

The marks are a row per file and day of loading (:func:`marks`), however many
records a file brings; records meet them by file and day.

Defined cases: a record without a readable time has no period and is no case; a
record ahead of its load's date is on time; null sources form one source; a null
or unreadable load date leaves the record without a verdict; empty input gives
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.operators.timestamps import first_instant, with_instants
from fleetloom.session import checkpointed, small_side

LATE_FROM, CUTOFF, IDLE = 2, 7, 3
DAY_US = 86_400_000_000


def event_day(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY_US).cast("int"))


def verdict(event: Column, arrived: Column, source_mark: Column, table_mark: Column, late_from: int = LATE_FROM) -> Column:
    """on_time, corrects or dropped: the record's day against both watermarks at its load."""
    return (
        F.when(event.isNull() | arrived.isNull(), F.lit(None).cast("string"))
        .when(event < F.greatest(source_mark, table_mark), "dropped")
        .when(F.datediff(arrived, event) >= late_from, "corrects")
        .otherwise("on_time")
    )


def marks(logs: DataFrame, cutoff: int = CUTOFF, idle: int = IDLE) -> DataFrame:
    """(source_file, ingestion_date, source, arrived_day, source_mark, table_mark): for each file and
    day of loading its source's low watermark and the table's watermark after that day's loads."""
    files = logs.select("source_file", "ingestion_date").distinct()
    files = files.withColumns({"source": feed(F.col("source_file")), "arrived_day": F.col("ingestion_date").try_cast("date")}).where("arrived_day IS NOT NULL")
    files = checkpointed(files)  # read three times
    so_far = Window.partitionBy("source").orderBy("arrived_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    files = files.withColumn("source_mark", F.date_sub(F.max("arrived_day").over(so_far), cutoff))
    table = watermarks(files.select("source", "arrived_day"), cutoff, idle).withColumnRenamed("watermark", "table_mark")
    return files.join(table, "arrived_day", "left")


def judged(logs: DataFrame, clocks: DataFrame, late_from: int = LATE_FROM, cutoff: int = CUTOFF, idle: int = IDLE) -> DataFrame:
    """Each row with event_day, arrived_day, source, both marks and verdict."""
    df = with_instants(
        logs.select("batch_id", "row_id", "source_file", "ingestion_date", "TM_STAMP", "DATA_SERVIDOR", F.col("`S/N ou IMEI`")), clocks
    ).select("batch_id", "row_id", "source_file", "ingestion_date", event_day(F.coalesce(first_instant(F.col("tm")), first_instant(F.col("ds")))).alias("event_day"))
    known = small_side(marks(logs, cutoff, idle)).withColumnsRenamed({"source_file": "__file", "ingestion_date": "__date"})
    df = df.join(known, F.col("source_file").eqNullSafe(F.col("__file")) & (F.col("ingestion_date") == F.col("__date")), "left")
    own = verdict(F.col("event_day"), F.col("arrived_day"), F.col("source_mark"), F.col("table_mark"), late_from)
    return df.select("batch_id", "row_id", "source", "event_day", "arrived_day", "source_mark", "table_mark", own.alias("verdict"))


def feed(source_file: Column) -> Column:
    """The feed that a file belongs to: its name without the load's time and revision."""
    return F.regexp_replace(source_file, r"_?\d{8,}|_rev|\.csv$", "")


def late_rows(logs: DataFrame, clocks: DataFrame, late_from: int = LATE_FROM, cutoff: int = CUTOFF) -> DataFrame:
    return (
        judged(logs, clocks, late_from, cutoff)
        .where(F.col("verdict").isin("corrects", "dropped"))
        .select("batch_id", "row_id", F.date_format("event_day", "yyyy-MM-dd").alias("event_date"), "verdict")
    )


def watermarks(loads: DataFrame, cutoff: int = CUTOFF, idle: int = IDLE) -> DataFrame:
    """(arrived_day, watermark) of the table from (source, arrived_day) punctuations.

    Between two loads a source holds the table at its last one, for ``idle`` days
    at most; then it counts as idle until it loads again.
    """
    loads = loads.where("arrived_day IS NOT NULL").distinct()
    after = F.lead("arrived_day").over(Window.partitionBy("source").orderBy("arrived_day"))
    idle_from = F.date_add("arrived_day", idle)
    loads = loads.withColumn("last", F.least(F.coalesce(F.date_sub(after, 1), idle_from), idle_from))
    held = loads.select(F.col("arrived_day").alias("held"), F.explode(F.sequence("arrived_day", "last")).alias("arrived_day"))
    low = held.groupBy("arrived_day").agg(F.min("held").alias("low"))
    # one row per calendar day, whatever the volume
    rising = F.max("low").over(Window.orderBy("arrived_day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return low.select("arrived_day", F.date_sub(rising, cutoff).alias("watermark"))


def daily_totals(logs: DataFrame, clocks: DataFrame, late_from: int = LATE_FROM, cutoff: int = CUTOFF, idle: int = IDLE) -> DataFrame:
    """Per event day: rows on time, correcting and dropped, the corrected total,
    the number of loads that revised it and the day on which it closed."""
    by_load = judged(logs, clocks, late_from, cutoff, idle).groupBy("event_day", "arrived_day", "verdict").agg(F.count(F.lit(1)).alias("n"))
    n = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).cast("bigint")
    days = by_load.where("event_day IS NOT NULL AND arrived_day IS NOT NULL").groupBy("event_day").agg(
        n("on_time").alias("on_time_count"), n("corrects").alias("corrected_count"), n("dropped").alias("dropped_count"),
        F.countDistinct(F.when(F.col("verdict") == "corrects", F.col("arrived_day"))).alias("revisions"),
    )
    closing = closings(days.select("event_day"), table_marks(logs, cutoff, idle))
    return (
        days.join(closing, "event_day")
        .withColumn("total_count", F.col("on_time_count") + F.col("corrected_count"))
        .select(
            F.date_format("event_day", "yyyy-MM-dd").alias("event_date"), "on_time_count", "corrected_count", "dropped_count", "total_count",
            "revisions", F.date_format("closed_on", "yyyy-MM-dd").alias("closed_on"),
        )
    )


def table_marks(logs: DataFrame, cutoff: int = CUTOFF, idle: int = IDLE) -> DataFrame:
    """(arrived_day, watermark) of a table of loads."""
    loads = logs.select("source_file", "ingestion_date").distinct()
    return watermarks(loads.select(feed(F.col("source_file")).alias("source"), F.col("ingestion_date").try_cast("date").alias("arrived_day")), cutoff, idle)


def closings(days: DataFrame, table: DataFrame) -> DataFrame:
    """(event_day, closed_on): the first day of loading whose watermark lies beyond the period."""
    # both sides have a row per calendar day
    steps = table.groupBy("watermark").agg(F.min("arrived_day").alias("closed_on"))
    timeline = days.select(F.col("event_day").alias("d"), F.lit(1).alias("is_day"), F.lit(None).cast("date").alias("closed_on")).unionByName(
        steps.select(F.col("watermark").alias("d"), F.lit(0).alias("is_day"), "closed_on")
    )
    later = Window.orderBy(F.desc("d"), F.desc("is_day")).rowsBetween(Window.unboundedPreceding, -1)
    return timeline.withColumn("closed_on", F.min("closed_on").over(later)).where("is_day = 1").select(F.col("d").alias("event_day"), "closed_on")


def diverted(logs: DataFrame, clocks: DataFrame, late_from: int = LATE_FROM, cutoff: int = CUTOFF, idle: int = IDLE) -> DataFrame:
    """Per event day with dropped records: the day it closed, and how many records were diverted before
    that (behind their own source's watermark only) and from then on."""
    days = judged(logs, clocks, late_from, cutoff, idle).where("verdict = 'dropped'").groupBy("event_day", "arrived_day").agg(F.count(F.lit(1)).alias("n"))
    days = checkpointed(days)  # a row per pair of days, read twice
    closed = closings(days.select("event_day").distinct(), table_marks(logs, cutoff, idle))
    after = F.coalesce(F.col("arrived_day") >= F.col("closed_on"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return days.join(closed, "event_day").groupBy("event_day", "closed_on").agg(n(~after).alias("before_closing_count"), n(after).alias("after_closing_count")).select(
        F.date_format("event_day", "yyyy-MM-dd").alias("event_date"), F.date_format("closed_on", "yyyy-MM-dd").alias("closed_on"), "before_closing_count", "after_closing_count"
    )
