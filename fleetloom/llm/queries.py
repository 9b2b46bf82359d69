"""Queries of the subpackage and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions.geo import epoch_us, usable
from fleetloom.llm import encode, history, leaks, runs, truncation
from fleetloom.plans import time_sql
from fleetloom.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loads taken into an empty history in their order; its runs go once the last one is in."""
    store = history.History(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", compact_after=4)
    found = store.add_in_order(_table(spark, sf_dir, "tracker_logs"), _table(spark, sf_dir, "device_clocks"))
    store.forget()
    return found


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.near_runs(_table(spark, sf_dir, "telemetry_events"))


def p6_exact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs at exactly the same position, with their duration in seconds."""
    df = _table(spark, sf_dir, "telemetry_events")
    df = df.where(F.col("device_serial").isNotNull() & usable(F.col("latitude"), F.col("longitude")))
    df = df.withColumn("us", epoch_us(df, "event_timestamp")).where("us IS NOT NULL").groupBy("device_serial", "us")
    df = df.agg(F.min(F.struct("ingested_at", "row_id", "latitude", "longitude")).alias("e"))
    df = df.select("device_serial", F.floor(F.col("us") / 86_400_000_000).alias("day"), "us", "e.latitude", "e.longitude")
    out = runs.collapse_runs(df, ["device_serial"], "us", ["latitude", "longitude"], "day")
    return out.select(
        "device_serial", "latitude", "longitude", F.floor(F.col("first") / 1_000_000).alias("first_s"), F.floor(F.col("last") / 1_000_000).alias("last_s"),
        "event_count", F.floor(F.col("duration") / 1_000_000).alias("duration_s"),
    )


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(_table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids don't decode to their text: none."""
    documents = _table(spark, sf_dir, "documents")
    back = encode.decode(encode.encode(documents)).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").where("text <> decoded").select("doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    found = leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("doc_count"), F.max("word_count").alias("most_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_texts(_table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(_table(spark, sf_dir, "documents"))


def _same(c: str) -> str:
    """SQL for: two readings agree up to writing, last digit or a lost value."""
    a, b = (f"replace(upper(trim(coalesce({x}.\"{c}\", ''))), ',', '.')" for x in "ab")
    lost = ", ".join(f"'{x}'" for x in sorted(history.LOST))
    x, y = f"TRY_CAST({a} AS DOUBLE)", f"TRY_CAST({b} AS DOUBLE)"
    digits = f"least(length(split_part({a}, '.', 2)), length(split_part({b}, '.', 2)))"
    return f"({a} = {b} OR {a} IN ({lost}) OR {b} IN ({lost}) OR coalesce({x} = {y} OR {digits} > 0 AND abs({x} - {y}) <= 1.000001 * pow(10, -{digits}), false))"


_P1 = f"""WITH {time_sql.placed()},
begun AS (SELECT batch_id, min(ingested_at) AS ord FROM tracker_logs GROUP BY batch_id),
keyed AS (
  SELECT placed.*, ord, nullif(regexp_replace(regexp_replace("S/N ou IMEI", '\\s+', '', 'g'), '^M', ''), '') AS device, trim("MESS_TYPE") AS kind, TRY_CAST(trim("SER_COUNT") AS DOUBLE) AS counter
  FROM placed JOIN begun USING (batch_id)),
valid AS (SELECT * FROM keyed WHERE device IS NOT NULL AND tm_us IS NOT NULL AND regexp_full_match(kind, 'T[0-9]+'))
SELECT a.batch_id, a.row_id FROM keyed a JOIN keyed b ON a.row_id = b.row_id AND b.ord < a.ord
UNION
SELECT a.batch_id, a.row_id FROM valid a JOIN valid b ON a.device = b.device AND a.kind = b.kind AND a.tm_us = b.tm_us AND b.ord < a.ord
WHERE coalesce(a.counter = b.counter, true) AND {' AND '.join(map(_same, history.READINGS))}"""

_P6 = """WITH RECURSIVE usable AS (
  SELECT device_serial, event_timestamp AS ts, arg_min(latitude, (ingested_at, row_id)) AS lat, arg_min(longitude, (ingested_at, row_id)) AS lon
  FROM telemetry_events
  WHERE device_serial IS NOT NULL AND event_timestamp IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
    AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0)
  GROUP BY ALL),
events AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY device_serial) AS n, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, false) AS late
  FROM usable WINDOW w AS (PARTITION BY device_serial ORDER BY ts)),
sessions AS (SELECT *, sum(late::INT) OVER (PARTITION BY device_serial ORDER BY i) AS session FROM events),
reach AS (
  SELECT a.device_serial, a.i, coalesce(min(b.i), any_value(a.n) + 1) AS stop FROM sessions a
  LEFT JOIN sessions b ON a.device_serial = b.device_serial AND b.i > a.i AND (b.session > a.session
    OR 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) > 60)
  GROUP BY 1, 2),
steps AS (SELECT *, CASE WHEN stop - i >= 3 THEN stop ELSE i + 1 END AS next FROM reach),
walk AS (SELECT * FROM steps WHERE i = 1 UNION ALL SELECT s.* FROM walk w JOIN steps s ON s.device_serial = w.device_serial AND s.i = w.next)
SELECT walk.device_serial, CAST(floor(epoch_us(a.ts) / 1000000) AS BIGINT) AS first_s, CAST(floor(epoch_us(b.ts) / 1000000) AS BIGINT) AS last_s, walk.stop - walk.i AS event_count
FROM walk JOIN events a ON a.device_serial = walk.device_serial AND a.i = walk.i JOIN events b ON b.device_serial = walk.device_serial AND b.i = walk.stop - 1
WHERE walk.stop - walk.i >= 3"""

_ENDINGS = r"""WITH shown AS (SELECT doc_id, source, regexp_replace(text, '[\s\x{00A0}\x{200B}\x{FEFF}]+$', '') AS t FROM documents),
judged AS (
  SELECT doc_id, source, coalesce(t, '') <> '' AS has_text,
    coalesce(t, '') <> '' AND (NOT regexp_matches(t, '[.!?。！？—–)\]"”»’]$') OR regexp_matches(t, '(…|\.\.)$') OR regexp_matches(t, '[(\[][^)\]]*$')
      OR (length(t) - length(replace(t, '"', ''))) % 2 = 1 AND regexp_matches(t, '"[^"]*$') AND NOT regexp_matches(t, '[)\]"]$')) AS cut
  FROM shown)"""


QUERIES = {
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
    "p1_found": p1_found,
    "p6_found": p6_found,
    "p6_exact_runs": p6_exact_runs,
}
SQL = {
    "p1_found": _P1,
    "p6_found": _P6,
    "p10_found": f"{_ENDINGS} SELECT doc_id FROM judged WHERE cut",
    "p10_rates": f"{_ENDINGS} SELECT source, count(*) FILTER (has_text) AS text_count, count(*) FILTER (cut) AS cut_count, round(count(*) FILTER (cut) / nullif(count(*) FILTER (has_text), 0), 6) AS cut_share FROM judged GROUP BY source",
    "p8_round_trip": "SELECT doc_id FROM documents WHERE false",
    "p6_exact_runs": """
WITH usable AS (
  SELECT device_serial, event_timestamp AS ts, arg_min(latitude, (ingested_at, row_id)) AS latitude, arg_min(longitude, (ingested_at, row_id)) AS longitude
  FROM telemetry_events
  WHERE device_serial IS NOT NULL AND event_timestamp IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
    AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0)
  GROUP BY ALL),
flagged AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(latitude) OVER w <> latitude OR lag(longitude) OVER w <> longitude THEN 1 ELSE 0 END AS starts
  FROM usable WINDOW w AS (PARTITION BY device_serial ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY device_serial ORDER BY ts) AS run FROM flagged)
SELECT device_serial, latitude, longitude, CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS first_s, CAST(floor(epoch_us(max(ts)) / 1000000) AS BIGINT) AS last_s,
  count(*) AS event_count, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS duration_s
FROM numbered GROUP BY device_serial, run, latitude, longitude
""",
}
