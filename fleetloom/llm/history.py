"""New batches checked against all history (problem 1).

Sorted-neighbourhood runs over two keys. By row id, an earlier batch holding the
same id decides. By message key (instant, device, type) records are sorted with
their batch's order, and each record is compared with the earlier ones in its
window, the records of its key: the counter must not contradict, and every reading
must agree up to writing, last digit or a lost value. Within a window exact copies
share one representative, so copies cost a lookup each, and no pairs are emitted.

:class:`History` keeps sorted runs on disk by key range, the day of the instant for
message keys and a span of file hashes for row ids. A new batch is sorted into runs
of the ranges it touches, reads those ranges of the past only, and only windows
around its own records; ranges with many runs are merged as part of taking it in.
:func:`copies_of_earlier` sorts everything at once, for comparison.

Defined cases: rows without a device, a placeable time or a valid type count by
row id only; a null row id matches none; null readings are lost values; rows
without a batch, and batches without any time, are neither found nor history;
batches that began at the same instant are not earlier than each other; empty
input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.plan import computed_once
from fleetloom.functions.streams import record_batches
from fleetloom.operators.lateness import DAY_US
from fleetloom.operators.timestamps import first_instant, with_instants
from fleetloom.session import checkpointed, small_side, together
from fleetloom.sources.store import Conflict, Staged, Table

#: The columns of a message that are readings.
READINGS = (
    "TIPO_LOG REPT_TYPE PRT_VER TERM_STATUS BAT_VOLT LOC_STATUS LAT LONT SPEED DIR INT_BATT ODO_TRIP ODO_TOTAL HORIMETER HDOP MCC MNC LAC CELL_ID "
    "RX_LEVEL TX_TECH GRP_MSG IO_STATUS DRIVER_ID PASS_ID RPM TACHO_SPD TACHO_ODO TEMP_1 TEMP_2 TEMP_3 TEMP_4"
).split()
LOST = frozenset({"", "N/A", "NA", "--", "-", "NULL", "NONE", "NAN", "INVALID"})
SEP = "\x1f"
#: The message key in its sort order: a load's records lie near each other in time.
KEY = ("us", "device", "type")


def batch_order(rows: DataFrame) -> DataFrame:
    """(batch_id, ord): batches in the order in which they began."""
    known = rows.where("batch_id IS NOT NULL AND ingested_at IS NOT NULL")
    return known.groupBy("batch_id").agg(F.min(F.unix_micros(F.col("ingested_at").cast("timestamp"))).alias("ord"))


def keyed_rows(logs: DataFrame, clocks: DataFrame, order: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(device, type, us, counter, readings, ord, batch_id, row_id); rows without a message key have null for it."""
    kept = ["batch_id", "row_id", "ingested_at", "TM_STAMP", "DATA_SERVIDOR", "MESS_TYPE", "SER_COUNT", *also]
    df = logs.select(*kept, F.col("`S/N ou IMEI`"), F.concat_ws(SEP, *[F.coalesce(F.col(c), F.lit("")) for c in READINGS]).alias("readings"))
    df = computed_once(with_instants(df, clocks), type=F.trim("MESS_TYPE"), us=first_instant(F.col("tm")))
    valid = F.col("__device").isNotNull() & F.col("us").isNotNull() & F.coalesce(F.col("type").rlike(r"\AT[0-9]+\z"), F.lit(False))
    key = {"device": F.col("__device"), "type": F.col("type"), "us": F.col("us"), "counter": counter(F.col("SER_COUNT")), "readings": F.col("readings")}
    return df.join(order, "batch_id").select(*[F.when(valid, c).alias(n) for n, c in key.items()], "ord", "batch_id", "row_id", *also)


def message_rows(logs: DataFrame, clocks: DataFrame) -> DataFrame:
    """The rows with a message key."""
    return keyed_rows(logs, clocks, batch_order(logs)).where("us IS NOT NULL")


def counter(text: Column) -> Column:
    """The counter as a number; null where it has none."""
    return F.trim(F.regexp_replace(text, ",", ".")).try_cast("double")


def same_reading(a: str, b: str) -> bool:
    """Equal up to case and spaces, up to one unit of the coarser last digit, or one is lost."""
    if a == b:
        return True
    a, b = a.strip().upper(), b.strip().upper()
    if a == b or a in LOST or b in LOST:
        return True
    a, b = a.replace(",", "."), b.replace(",", ".")
    try:
        x, y = float(a), float(b)
    except ValueError:
        return False
    if x == y:
        return True
    digits = min(len(a.partition(".")[2]), len(b.partition(".")[2]))
    return digits > 0 and abs(x - y) <= 1.000001 * 10.0**-digits


def same_message(a: list[str], b: list[str]) -> bool:
    return all(map(same_reading, a, b))


#: Readings that are whole numbers as a rule, and change from message to message.
WHOLE = [READINGS.index(c) for c in ("ODO_TOTAL", "RX_LEVEL", "DIR", "SPEED")]


def _whole(reading: str) -> float | None:
    """The reading if it is a whole number. Two that differ are never the same
    reading; anything else may agree with several."""
    try:
        x = float(reading.replace(",", "."))
    except ValueError:
        return None
    return x if x.is_integer() else None


class Neighbourhood:
    """The earlier records of one message key, an exact copy once.

    Records come in batch order; those of one batch see earlier batches only.
    Variants hang in trees by their whole-number readings, so that a key with very
    many different records (a clock that stands still) compares likely ones only.
    """

    def __init__(self) -> None:
        self.seen: dict[tuple, int] = {}  # (counter, readings) -> first order
        self.all: dict = {}
        self.uncounted: dict = {}
        self.counted: dict[float, dict] = {}

    @staticmethod
    def _add(tree: dict, key: list, entry: tuple) -> None:
        for k in key[:-1]:
            tree = tree.setdefault(k, {})
        tree.setdefault(key[-1], []).append(entry)

    @staticmethod
    def _near(trees: list, key: list) -> Iterator[tuple]:
        """Entries whose whole readings don't contradict."""
        for k in key:
            trees = [b for t in trees for b in (t.values() if k is None else (t[x] for x in (k, None) if x in t))]
        for entries in trees:
            yield from entries

    def found(self, number: float | None, readings: str, order: int) -> bool:
        first = self.seen.get((number, readings))
        if first is not None and first < order:
            return True
        mine = readings.split(SEP)
        key = [_whole(mine[i]) for i in WHOLE]
        trees = [self.all] if number is None else [self.uncounted, self.counted.get(number, {})]
        hit = any(o < order and same_message(mine, r) for r, o in self._near(trees, key))
        if first is None:
            self.seen[(number, readings)] = order
            entry = (mine, order)
            self._add(self.all, key, entry)
            self._add(self.uncounted if number is None else self.counted.setdefault(number, {}), key, entry)
        return hit


_FOUND = pa.schema([("batch_id", pa.string()), ("row_id", pa.string())])


def message_copies(rows: DataFrame, only: Column | None = None) -> DataFrame:
    """(batch_id, row_id) of message rows that an earlier batch holds.

    ``only`` marks the rows that are asked about; the others are history.
    """
    key = list(KEY)
    rows = rows.withColumn("asked", F.lit(True) if only is None else only)
    shared = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = rows.withColumn("n", shared).where("n > 1").sortWithinPartitions(*key, "ord", "batch_id", "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            last, hood = None, Neighbourhood()
            for b in batches:
                for us, device, kind, number, readings, order, batch, row, asked in zip(*(c.to_pylist() for c in b.columns)):
                    if (us, device, kind) != last:
                        last, hood = (us, device, kind), Neighbourhood()
                    if hood.found(number, readings, order) and asked:
                        yield batch, row

        yield from record_batches(found(), _FOUND)

    return rows.select(*key, "counter", "readings", "ord", "batch_id", "row_id", "asked").mapInArrow(run, "batch_id string, row_id string")


def id_copies(rows: DataFrame) -> DataFrame:
    """(batch_id, row_id) of rows whose id an earlier batch holds; (row_id, batch_id, ord) in."""
    first = F.min("ord").over(Window.partitionBy("row_id"))
    return rows.where("row_id IS NOT NULL").withColumn("first", first).where("ord > first").select("batch_id", "row_id")


def copies_of_earlier(logs: DataFrame, clocks: DataFrame) -> DataFrame:
    """All batches at once: every (batch_id, row_id) that an earlier batch holds."""
    by_id = id_copies(logs.select("row_id", "batch_id").join(batch_order(logs), "batch_id"))
    return by_id.unionByName(message_copies(message_rows(logs, clocks))).distinct()


class History:
    """Accepted rows as sorted runs by key range, in two tables of the store.

    ``table`` holds the records sorted by message key, one range per UTC day of the
    instant (``-``: records without a key). ``ids`` holds the row ids sorted by file,
    one range per span of file hashes, and with them the directory of the files. A
    row id is the digest of file hash and number, so its file tells where it lies;
    ids that aren't have the range ``odd``, and where such ids are about, ids are
    compared through the whole run set instead.

    Taking in a batch: sort and stage its runs, compare them with the published past,
    publish both, merge ranges that have many runs. The result is written before
    anything is published, and a token of the batches keeps a retry from publishing
    twice. Where another writer publishes meanwhile, the comparison is repeated.
    """

    def __init__(self, spark, path: str, ranges: int = 64, compact_after: int = 16) -> None:
        self.spark, self.path, self.ranges, self.compact_after = spark, path.rstrip("/"), ranges, compact_after
        self.table, self.ids = Table(spark, self.path), Table(spark, f"{self.path}/ids")
        self.reads: list[dict[str, int]] = []  # leaves of the past that each step opened, and all there were

    # --- runs ---------------------------------------------------------------

    def _prepared(self, logs: DataFrame, clocks: DataFrame, order: DataFrame) -> DataFrame:
        """All rows with message key, file and both ranges."""
        if {"source_file_hash", "source_row_number"} <= set(logs.columns):
            own = F.sha2(F.concat_ws(":", "source_file_hash", F.col("source_row_number").cast("string")), 256)
            derived = F.coalesce((F.col("row_id") == own) & F.col("source_file_hash").rlike("^[0-9a-f]{4}"), F.lit(False))
            logs = logs.withColumn("__file", F.when(derived, F.col("source_file_hash")))
        else:
            logs = logs.withColumn("__file", F.lit(None).cast("string"))
        span = F.floor(F.conv(F.substring("__file", 1, 4), 16, 10).cast("bigint") * self.ranges / 65_536)
        part = F.coalesce(F.format_string("%05d", span.cast("int")), F.lit("odd"))
        day = F.coalesce(F.floor(F.col("us") / DAY_US).cast("string"), F.lit("-"))
        part = F.when(F.col("__file").isNull(), F.lit("odd")).otherwise(part)
        return keyed_rows(logs, clocks, order, ("__file",)).withColumns({"day": day, "part": part}).withColumnRenamed("__file", "file")

    @staticmethod
    def _records(rows: DataFrame) -> DataFrame:
        return rows.select(*KEY, "counter", "readings", "ord", "batch_id", "row_id", F.col("day").alias("key_range"))

    @staticmethod
    def _ids(rows: DataFrame) -> DataFrame:
        """(row_id, file, ord, batch_id, part, key_range): row ids by part, and the files under ``files``."""
        ids = rows.where("row_id IS NOT NULL").select("row_id", "file", "ord", "batch_id", "part", F.col("part").alias("key_range"))
        files = rows.where("row_id IS NOT NULL AND file IS NOT NULL").select("file", "ord", "batch_id", "part").distinct()
        return ids.unionByName(files.withColumns({"row_id": F.lit(None).cast("string"), "key_range": F.lit("files")}))

    # --- comparison ---------------------------------------------------------

    def _past(self, table: Table, version: int, ranges: set) -> DataFrame:
        m = table.manifest(version)
        self.reads[-1][table.path] = sum(v in ranges for _, v in m.segments)
        self.reads[-1][f"{table.path} of"] = len(m.segments)
        return table.read(partitions=ranges, version=version)

    def _by_message(self, new: DataFrame, touched: set, version: int) -> DataFrame:
        """Copies by message key, from windows around the new records."""
        columns = [*KEY, "counter", "readings", "ord", "batch_id", "row_id"]
        asked = new.where("us IS NOT NULL").select(*columns, F.lit(True).alias("asked"))
        keys = small_side(asked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
        twice = keys.where("n > 1").select(*KEY)
        near = None
        if version >= 0:
            near = self._past(self.table, version, touched - {"-"}).where("us IS NOT NULL").join(keys.select(*KEY), list(KEY), "left_semi")
            near = checkpointed(near.select(*columns, F.lit(False).alias("asked")))
            twice = twice.unionByName(near.select(*KEY)).distinct()
        rows = asked.join(small_side(twice), list(KEY), "left_semi")
        return message_copies(rows if near is None else rows.unionByName(near), F.col("asked"))

    def _by_id(self, new: DataFrame, touched: set, version: int) -> DataFrame:
        """Copies by row id, looked up through the directory of files."""
        asked = new.where("row_id IS NOT NULL")
        ranges = set() if version < 0 else {v for _, v in self.ids.manifest(version).segments}
        past = None
        if "odd" in touched | ranges:
            if version >= 0:
                past = self._past(self.ids, version, ranges - {"files"}).join(asked.select("row_id").distinct(), "row_id", "left_semi")
        else:
            now = new.where("row_id IS NULL").groupBy("file").agg(F.countDistinct("ord").alias("n"), F.first("part").alias("part"))
            known = now.where("n > 1").select("file")
            if version >= 0:
                directory = self.ids.read(partitions={"files"}, version=version).select("file").distinct()
                again = small_side(now.join(directory, "file", "left_semi").select("file", "part"))
                touched = {r[0] for r in again.select("part").distinct().collect()}  # at most as many as there are ranges
                past = self._past(self.ids, version, touched).join(again.select("file"), "file", "left_semi")
                known = known.unionByName(again.select("file")).distinct()
            asked = asked.join(small_side(known), "file", "left_semi")
        rows = asked.select("row_id", "batch_id", "ord", F.lit(True).alias("asked"))
        if past is not None:
            rows = rows.unionByName(past.select("row_id", "batch_id", "ord", F.lit(False).alias("asked")))
        first = F.min("ord").over(Window.partitionBy("row_id"))
        return rows.withColumn("first", first).where("asked AND ord > first").select("batch_id", "row_id")

    # --- steps --------------------------------------------------------------

    def add(self, logs: DataFrame, clocks: DataFrame) -> DataFrame:
        """Take one new batch, or several at once; gives their (batch_id, row_id) that earlier batches hold.

        Rows join history whether copies or not: a later copy of a copy is one of the original as well.
        """
        order = small_side(batch_order(logs))
        loads = sorted((r["ord"], r["batch_id"]) for r in order.collect())  # a row per load
        return self._take(self._prepared(logs, clocks, order), loads)

    def _take(self, rows: DataFrame, loads: list[tuple]) -> DataFrame:
        token = hashlib.sha256(repr(loads).encode()).hexdigest()[:32]
        staged = together({
            "records": lambda: self.table.stage(self._records(rows), "key_range", [*KEY, "ord"]),
            "ids": lambda: self.ids.stage(self._ids(rows), "key_range", ["file", "row_id"]),
        })
        records, ids = staged["records"], staged["ids"]
        while True:
            versions = [t.manifest().version if t.exists() else -1 for t in (self.table, self.ids)]
            found = self._found(records, ids, versions, token)
            try:
                for t, staged, version in zip((self.table, self.ids), (records, ids), versions):
                    t.publish(staged, token, version)
                break
            except Conflict:
                continue
        self.compact()
        return found

    def _found(self, records: Staged, ids: Staged, versions: list[int], token: str) -> DataFrame:
        self.reads.append({})
        copies = together({
            "id": lambda: self._by_id(self.ids.leaves(ids.leaves, ids.struct), ids.values, versions[1]),
            "message": lambda: self._by_message(self.table.leaves(records.leaves, records.struct), records.values, versions[0]),
        })
        target = f"{self.path}/found/{token}"
        copies["id"].unionByName(copies["message"]).distinct().write.mode("overwrite").parquet(target)
        return self.spark.read.schema("batch_id string, row_id string").parquet(target)

    def add_in_order(self, logs: DataFrame, clocks: DataFrame, at_once: int = 32) -> DataFrame:
        """Take a table of many loads in the order in which they began, ``at_once`` at a time.

        Keys of all rows are made in one pass that lays the rows out by step; each
        step then reads its own rows and what of the past they touch.
        """
        order = batch_order(logs)
        loads = sorted((r["ord"], r["batch_id"]) for r in order.collect())  # a row per load
        steps = [loads[i : i + at_once] for i in range(0, len(loads), at_once)]
        listed = self.spark.createDataFrame([(b, o, k) for k, step in enumerate(steps) for o, b in step], "batch_id string, ord bigint, step int")
        offered = f"{self.path}/offered"
        rows = self._prepared(logs, clocks, small_side(listed.drop("step"))).join(small_side(listed.select("batch_id", "step")), "batch_id")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("step").parquet(offered)
        found = logs.select("batch_id", "row_id").limit(0)
        for k, step in enumerate(steps):
            found = found.unionByName(self._take(self.spark.read.schema(rows.drop("step").schema).parquet(f"{offered}/step={k}"), step))
        self.table.files.delete(offered)
        return found

    def forget(self) -> None:
        """Delete the runs; results that were handed out stay."""
        for part in ("_log", "data", "ids"):
            self.table.files.delete(f"{self.path}/{part}")

    def runs(self) -> dict[str, int]:
        """Runs of each key range."""
        return dict(Counter(r for _, r in self.table.manifest().segments)) if self.table.exists() else {}

    def compact(self) -> list[str]:
        """Merge the runs of ranges that have many; gives the ranges of message keys."""
        merged = []
        for table, order in ((self.table, [*KEY, "ord"]), (self.ids, ["file", "row_id"])):
            if not table.exists():
                continue
            m = table.manifest()
            many = sorted(r for r, n in Counter(r for _, r in m.segments).items() if n > self.compact_after)
            if many:
                table.replace_where(table.read(partitions=many, version=m.version), many, order, based_on=m.version)
                merged += many if table is self.table else []
        return merged
