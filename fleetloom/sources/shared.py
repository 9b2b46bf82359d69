"""The inbox in folders that executors share, for any storage that Hadoop and Arrow reach.

As :mod:`fleetloom.sources.inbox`, with the same control log, order of effects and
reasons; but files are hashed and judged by executors, two passes over each file's
bytes, and whether a file was loaded before is a join of digests. The driver sees
names and one row per offered file. Moves are renames in the shared storage.

Defined cases: of files with equal contents in one run the first by name loads, the
others are skipped; a file that vanishes meanwhile fails without a digest; a folder
without CSV files gives an empty result; a name that is taken in the archive or the
quarantine gets a suffix.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetloom.session import checkpointed
from fleetloom.sources import inbox
from fleetloom.sources.inbox import Checked, Loaded, control_event
from fleetloom.sources.store import Files, Table

BLOCK = 1_048_576


class Place(str):
    """A file's full address; its name as the local inbox has it."""

    @property
    def name(self) -> str:
        return self.rpartition("/")[2]

    @property
    def suffix(self) -> str:
        dot = self.name.rfind(".")
        return self.name[dot:] if dot > 0 else ""


@dataclass(frozen=True)
class Folders:
    inbox: str
    archive: str
    quarantine: str

    @staticmethod
    def under(spark: SparkSession, root: str) -> Folders:
        made = Folders(*(f"{root.rstrip('/')}/{n}" for n in ("inbox", "archive", "quarantine")))
        for f in (made.inbox, made.archive, made.quarantine):
            Files(spark).make(f)
        return made


def discover(spark: SparkSession, folder: str) -> list[Place]:
    """CSV files right in the folder, by name without case."""
    found = [Place(f"{folder}/{n}") for n in Files(spark).names(folder)]
    return sorted((p for p in found if p.suffix.lower() == ".csv"), key=lambda p: p.name.lower())


def judge(opened, place: Place) -> tuple[str, Checked]:
    """Digest and structure of a file; ``opened()`` gives its bytes as a stream."""
    digest, decoder, encoding, size = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), "utf-8-sig", 0
    with opened() as f:
        while part := f.read(BLOCK):
            digest.update(part)
            size += len(part)
            if encoding != "latin-1":
                try:
                    decoder.decode(part)
                except UnicodeDecodeError:
                    encoding = "latin-1"
    if encoding != "latin-1":
        try:
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            encoding = "latin-1"
    if not size:
        return digest.hexdigest(), Checked(place, "the file is empty")
    with opened() as f:
        return digest.hexdigest(), inbox.judge_text(place, encoding, io.TextIOWrapper(f, encoding=encoding, newline=""))


JUDGED = "place string, digest string, error string, row_count bigint, header array<string>, encoding string, missing array<string>, reserved array<string>, began timestamp"


def judged(spark: SparkSession, places: list[Place]) -> DataFrame:
    """A row per file, judged where the task runs."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for place in map(Place, pdf["place"]):
                began = datetime.now(UTC)
                try:
                    local = place.startswith(("file:", "/"))
                    system, inner = (fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(place)
                    digest, c = judge(lambda system=system, inner=inner: system.open_input_stream(inner), place)
                    rows.append((place, digest, c.error, c.row_count, list(c.header), c.encoding, list(c.missing), list(c.reserved), began))
                except (OSError, csv.Error) as e:
                    rows.append((place, None, f"no hash: {e}", 0, [], None, [], [], began))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in JUDGED.split(", ")])

    files = spark.createDataFrame([(p,) for p in places], "place string").repartition(min(len(places), 4 * spark.sparkContext.defaultParallelism))
    return files.mapInPandas(run, JUDGED)


def _loaded_before(found: DataFrame, bronze: Table, control: Table) -> DataFrame:
    """Add ``known``: the log calls a file of these contents loaded and the table holds it, or an earlier name offers it too."""
    twin = F.row_number().over(Window.partitionBy("digest").orderBy(F.lower("place"), "place")) > 1
    found = found.withColumn("known", F.col("digest").isNotNull() & twin)
    if not (bronze.exists() and control.exists()):
        return found
    done = control.read().where("status = 'SUCCESS'").select(F.col("source_file_hash").alias("digest")).join(found.select("digest"), "digest", "left_semi")
    done = done.join(bronze.read().select(F.col("source_file_hash").alias("digest")), "digest", "left_semi").distinct().withColumn("__done", F.lit(True))
    return found.join(done, "digest", "left").withColumn("known", F.col("known") | F.coalesce("__done", F.lit(False))).drop("__done")


def _move(files: Files, place: Place, folder: str) -> str:
    target, name = f"{folder}/{place.name}", place.name
    while files.exists(target):
        stem, dot, suffix = name.rpartition(".")
        target = f"{folder}/{stem}__{datetime.now(UTC):%Y%m%dT%H%M%S%f}{dot}{suffix}"
    files.rename(place, target)
    return target


def load(spark: SparkSession, folders: Folders, bronze: Table, control: Table, ingested_at: datetime | None = None) -> Loaded:
    """Take all files of the inbox as one batch."""
    batch_id, files = str(uuid.uuid4()), Files(spark)
    places = discover(spark, folders.inbox)
    if not places:
        return Loaded(batch_id, 0, (), ())
    found = checkpointed(judged(spark, places))  # each file is read once
    events, checked, sound, done, bad = [], [], [], [], []
    for r in sorted(_loaded_before(found, bronze, control).collect(), key=lambda r: r["place"].lower()):  # a row per offered file
        place, digest, began = Place(r["place"]), r["digest"], inbox.utc(r["began"])
        began = min(began, datetime.now(UTC))
        if digest is None:
            events.append(control_event(batch_id, place.name, None, "FAILED", began, error_message=r["error"]))
            continue
        if r["known"]:
            events.append(control_event(batch_id, place.name, digest, "SKIPPED", began, inserted_row_count=0, status_reason="loaded before"))
            done.append(place)
            continue
        c = Checked(place, r["error"], r["row_count"], tuple(r["header"]), r["encoding"], tuple(r["missing"]), tuple(r["reserved"]))
        checked.append(c)
        events.append(control_event(batch_id, place.name, digest, "PROCESSING", began))
        if c.valid:
            sound.append((c, digest, began))
        else:
            events.append(control_event(batch_id, place.name, digest, "FAILED", began, row_count=c.row_count, inserted_row_count=0, duplicate_row_count=0, error_message=c.error))
            bad.append(c)
    inbox._log(control, events)
    for c in bad:
        target = _move(files, c.path, folders.quarantine)
        files.create(f"{target}.error.txt", inbox.report(replace(c, path=Place(c.path))))
    inserted = inbox.insert(spark, sound, batch_id, bronze, control, ingested_at)
    for place in [*done, *(c.path for c, _, _ in sound)]:
        _move(files, place, folders.archive)
    return Loaded(batch_id, sum(inserted.values()), tuple(sorted(inserted)), tuple(checked))
