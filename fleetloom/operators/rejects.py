"""Rows that fail to parse, apart from the good ones and with a reason (problem 5).

A quote-aware finite-state tokenizer reads raw records. Its states are field
start, unquoted, quoted and after-a-quote; a chunk of text is summarised as the
function from entry state to exit state, commas and first error, and summaries
compose, so long records and files are read in chunks in parallel.

Defined cases: null and blank lines are no records; an empty table gives an
empty result; a repeated key counts once; long texts are read whole, in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.streams import record_batches, slices
from fleetloom.functions.timeparse import with_readings

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
CHUNK = 65_536
COLUMNS = 37
#: Positions of the checked columns in a record.
SERVER, DEVICE, TYPE, SERIAL = 0, 1, 3, 6


class Effect(NamedTuple):
    """What a chunk does from one entry state."""

    state: int
    commas: int
    error: int | None  # offset of the first error in the chunk


def effect(chunk: str, state: int) -> Effect:
    """Run the machine over a chunk, jumping from one quote or comma to the next."""
    i, commas, n = 0, 0, len(chunk)
    while i < n:
        if state == QUOTED:
            j = chunk.find('"', i)
            if j < 0:
                return Effect(QUOTED, commas, None)
            state, i = CLOSED, j + 1
            continue
        c = chunk[i]
        if state == CLOSED:
            if c == '"':
                state = QUOTED
            elif c == ",":
                state, commas = START, commas + 1
            else:
                return Effect(BROKEN, commas, i)
            i += 1
        elif state == START:
            if c == '"':
                state = QUOTED
            elif c == ",":
                commas += 1
            else:
                state = PLAIN
            i += 1
        elif state == PLAIN:
            j = chunk.find(",", i)
            q = chunk.find('"', i, n if j < 0 else j)
            if q >= 0:
                return Effect(BROKEN, commas, q)
            if j < 0:
                return Effect(PLAIN, commas, None)
            state, commas, i = START, commas + 1, j + 1
        else:
            return Effect(BROKEN, commas, 0)
    return Effect(state, commas, None)


def transition(chunk: str) -> tuple[Effect, ...]:
    """The chunk as a function of the entry state."""
    return tuple(effect(chunk, s) for s in (START, PLAIN, QUOTED, CLOSED, BROKEN))


def compose(first: tuple[Effect, ...], length: int, second: tuple[Effect, ...]) -> tuple[Effect, ...]:
    """The two chunks as one; ``length`` is the first chunk's."""
    out = []
    for a in first:
        b = second[a.state]
        error = a.error if a.error is not None else None if a.state == BROKEN or b.error is None else length + b.error
        out.append(Effect(b.state, a.commas + (0 if a.state == BROKEN else b.commas), error))
    return tuple(out)


def scan(record: str, chunk: int = CHUNK) -> Effect:
    """A record's end state, commas and first error, through composed chunks."""
    if len(record) <= chunk:
        done = effect(record, START)
    else:
        total, seen = transition(record[:chunk]), chunk
        for i in range(chunk, len(record), chunk):
            part = record[i : i + chunk]
            total = compose(total, seen, transition(part))
            seen += len(part)
        done = total[START]
    if done.state == QUOTED:  # never closed
        return Effect(BROKEN, done.commas, len(record))
    return done


def fields(record: str) -> list[str]:
    """The fields of a record that :func:`scan` found whole."""
    if '"' not in record:
        return record.split(",")
    out, i = [], 0
    while True:
        if record.startswith('"', i):
            j = i + 1
            while True:
                j = record.index('"', j)
                if not record.startswith('"', j + 1):
                    break
                j += 2
            out.append(record[i + 1 : j].replace('""', '"'))
            i = j + 1
        else:
            j = record.find(",", i)
            j = len(record) if j < 0 else j
            out.append(record[i:j])
            i = j
        if i >= len(record):
            return out
        i += 1


TOKENS = "record_key string, defect string, offset bigint, n_fields int, values array<string>"


def tokenize(lines: DataFrame, key: str, text: str, width: int = COLUMNS) -> DataFrame:
    """Raw records to typed rows: values, or the structural defect and its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_key", pa.string()), ("defect", pa.string()), ("offset", pa.int64()), ("n_fields", pa.int32()), ("values", pa.list_(pa.string()))])
        for batch in slices(batches, 4096):
            rows: list[tuple] = []
            for k, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                e = scan(record)
                if e.state == BROKEN:
                    rows.append((k, "BROKEN_QUOTING", e.error, None, None))
                elif e.commas + 1 != width:
                    rows.append((k, "COLUMN_COUNT", len(record), e.commas + 1, None))
                else:
                    rows.append((k, None, None, width, fields(record)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return lines.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & ~F.col("t").rlike(r"^\s*$")).mapInArrow(run, TOKENS)


def content_reason(message: Column, named: Column, serial: Column) -> Column:
    """The first defect of a structurally sound row; null for a good one."""
    trimmed = F.trim(message)
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return (
        F.when(blank(message), "MISSING_MESSAGE_TYPE")
        .when(~trimmed.rlike(r"\AT[0-9]+\z"), "INVALID_MESSAGE_TYPE")
        .when(~named, "MISSING_OR_INVALID_TIMESTAMP")
        .when(blank(serial), "MISSING_DEVICE_SERIAL")
    )


def _named(df: DataFrame, first: str, second: str) -> DataFrame:
    return with_readings(with_readings(df, first, "__a"), second, "__b").withColumn("__named", F.col("__a_named") | F.col("__b_named"))


def judged_lines(lines: DataFrame, key: str = "line_key", text: str = "line_text") -> DataFrame:
    """Every record of raw lines: record_key, reason (null: good), offset and values."""
    at = lambda i: F.get(F.col("values"), F.lit(i))
    df = tokenize(lines, key, text).withColumns({"__tm": at(DEVICE), "__ds": at(SERVER)})
    df = _named(df, "__tm", "__ds")
    return df.select("record_key", F.coalesce("defect", content_reason(at(TYPE), F.col("__named"), at(SERIAL))).alias("reason"), "offset", "values")


def judged_logs(logs: DataFrame) -> DataFrame:
    """Every row of loaded logs: record_key and reason (null: good)."""
    df = logs.select("row_id", F.col("TM_STAMP").alias("__tm"), F.col("DATA_SERVIDOR").alias("__ds"), "MESS_TYPE", F.col("`S/N ou IMEI`").alias("__sn"))
    df = _named(df, "__tm", "__ds")
    return df.select(F.col("row_id").alias("record_key"), content_reason(F.col("MESS_TYPE"), F.col("__named"), F.col("__sn")).alias("reason"))


def rejected(lines: DataFrame, logs: DataFrame) -> DataFrame:
    """(record_key, reason) of all failing records, each key once.

    A key offered again with other contents keeps its alphabetically first reason.
    """
    bad = judged_lines(lines).select("record_key", "reason").unionByName(judged_logs(logs)).where("reason IS NOT NULL")
    return bad.groupBy("record_key").agg(F.min("reason").alias("reason"))


# --- raw files --------------------------------------------------------------

_LINES = "source_file string, block bigint, text string"
_FRAGMENTS = "source_file string, block bigint, at bigint, part bigint, line_text string"


def _after_line(line: str, state: int) -> int:
    """Whether the next line begins a record (START) or goes on inside a quote (QUOTED)."""
    return QUOTED if effect(line, state).state == QUOTED else START


def raw_lines(spark, path: str) -> DataFrame:
    """Lines of raw files with the file split that they lie in, in order within it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text")
    )


def records(lines: DataFrame) -> DataFrame:
    """Records of raw files, whose quoted fields may hold line breaks: source_file, line_key, line_text.

    Each file split is summarised as the function from the state before it to
    the state after it. The summaries of a file, a row per split, compose to the
    state and the open record at which each split starts; then the splits emit
    their records independently, and only records that cross a split meet again.
    A record that is broken ends with its line; an unclosed quote takes in the
    following lines up to the next quote.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}
        for b in batches:
            for file, block, text in zip(*(c.to_pylist() for c in b.columns)):
                # exit states for both entries, and whether a record began inside for each
                s = seen.setdefault((file, block), [START, QUOTED, 0, 0])
                for entry in (0, 1):
                    if s[entry] == START:
                        s[2 + entry] = 1
                    s[entry] = _after_line(text, s[entry])
        rows = [(f, b, *s) for (f, b), s in seen.items()]
        if rows:
            f, b, *s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(b, pa.int64()), *(pa.array(x, pa.int32()) for x in s)], names=["source_file", "block", "s0", "s1", "n0", "n1"])

    def enter(pdf):
        pdf = pdf.sort_values("block")
        state, head, out = START, 0, []
        for block, s0, s1, n0, n1 in zip(pdf["block"], pdf["s0"], pdf["s1"], pdf["n0"], pdf["n1"]):
            out.append((pdf["source_file"].iloc[0], block, state == QUOTED, head))
            state, began = (s0, n0) if state == START else (s1, n1)
            head = block if began else head
        return type(pdf)(out, columns=["source_file", "block", "inside", "head"])

    summaries = lines.mapInArrow(summarise, "source_file string, block bigint, s0 int, s1 int, n0 int, n1 int")
    entries = summaries.groupBy("source_file").applyInPandas(enter, "source_file string, block bigint, inside boolean, head bigint")
    # lines of a split stay in order: the join's other side is a row per split
    ordered = lines.withColumn("row", F.monotonically_increasing_id()).join(entries, ["source_file", "block"])
    ordered = ordered.repartition("source_file", "block").sortWithinPartitions("source_file", "block", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("part", pa.int64()), ("line_text", pa.string())])

        def rows():
            where, state, begun, at, held = None, START, 0, 0, []
            for b in batches:
                for file, block, text, inside, head in zip(*(c.to_pylist() for c in b.columns)):
                    if (file, block) != where:
                        if held:
                            yield where[0], begun, -1, where[1], "\n".join(held)
                        where, state, begun, at, held = (file, block), QUOTED if inside else START, head, 0, []
                    if state == START:
                        begun, at = block, at + 1
                    held.append(text)
                    state = _after_line(text, state)
                    if state == START:
                        # a record from an earlier split is known by that split alone
                        yield file, begun, at if begun == block and at else -1, block, "\n".join(held)
                        held = []
            if held:
                yield where[0], begun, -1, where[1], "\n".join(held)

        yield from record_batches(rows(), schema)

    fragments = ordered.select("source_file", "block", "text", "inside", "head").mapInArrow(cut, _FRAGMENTS)
    key = F.concat_ws("#", "source_file", F.col("block").cast("string"), F.col("at").cast("string")).alias("line_key")
    whole = fragments.where("at > 0").select("source_file", key, "line_text")
    crossing = fragments.where("at < 0").groupBy("source_file", "block", "at").agg(F.sort_array(F.collect_list(F.struct("part", "line_text"))).alias("parts"))
    return whole.unionByName(crossing.select("source_file", key, F.array_join(F.col("parts.line_text"), "\n").alias("line_text")))
