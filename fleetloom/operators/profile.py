"""Column-level profile of large tables and of their loads (problem 2).

Footers of the columnar files come first: they give row counts and null counts of
every column chunk. Where a dictionary covers a chunk, its dictionary page gives the
distinct values and with them the extrema, of floating columns as well; the data
pages aren't read. Only chunks without that, or without a null count, are read. The
comparison of loads scans the numeric columns, save those that footers prove to
hold one value that is possible: a load's rows share their chunks with other loads',
so no statistics of a chunk speak of a load.

Loads are compared straight from the columns: value counts of a load and column
combine before the shuffle, so a load with a third of all rows costs its distinct values.

Defined cases: an empty table has rows 0 and null extrema; nulls of the load
column form one load; NaN and infinities count as impossible, not as extrema;
fewer than ``min_values`` values of a load are no evidence on its distribution.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, NumericType

from fleetloom.session import checkpointed, shared_dir, small_side

CHUNKS = "file string, row_group int, column string, rows bigint, nulls bigint, low string, high string, exact boolean, dictionary boolean"


def _open(path: str, **kind):
    import pyarrow.parquet as pq
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
        return pq.ParquetFile(inner, filesystem=system, **kind)
    return pq.ParquetFile(path, **kind)


def _source(path: str):
    """The file's bytes at any offset."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def footer_chunks(table: DataFrame) -> DataFrame:
    """One row per column chunk of the table's files, from footers alone."""
    spark = table.sparkSession
    files = table.inputFiles()
    if not files:
        return spark.createDataFrame([], CHUNKS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["file"]:
                meta = _open(path).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        s = chunk.statistics
                        bounded = s is not None and s.has_min_max
                        whole = s is not None and s.has_null_count and (bounded or s.null_count == group.num_rows) and chunk.physical_type not in ("FLOAT", "DOUBLE")
                        rows.append(
                            (path, g, chunk.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None,
                             str(s.min) if bounded else None, str(s.max) if bounded else None, whole, chunk.has_dictionary_page)
                        )
            if rows:
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNKS.split(", ")])

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 1024)).mapInPandas(read, CHUNKS)


def _varint(b: memoryview, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if not b[i - 1] & 128:
            return n, i


def _struct(b: memoryview, i: int = 0) -> tuple[dict[int, object], int]:
    """A struct of the compact protocol that page headers are written in: field id to number, bytes or struct."""
    out: dict[int, object] = {}
    at = 0
    while b[i]:
        kind, delta, i = b[i] & 15, b[i] >> 4, i + 1
        if delta:
            at += delta
        else:
            n, i = _varint(b, i)
            at = (n >> 1) ^ -(n & 1)
        if kind in (1, 2):
            out[at] = kind == 1
        elif kind == 3:
            out[at], i = b[i], i + 1
        elif kind in (4, 5, 6):
            n, i = _varint(b, i)
            out[at] = (n >> 1) ^ -(n & 1)
        elif kind == 7:
            i += 8
        elif kind == 8:
            n, i = _varint(b, i)
            if i + n > len(b):
                raise IndexError
            i += n
        elif kind == 12:
            out[at], i = _struct(b, i)
        else:
            raise ValueError("no page header")
    return out, i + 1


# fixed values of the file format: page types and encodings
DATA, DICTIONARY, DATA_V2 = 0, 2, 3
CODED = (2, 8)
CODECS = {"UNCOMPRESSED": None, "SNAPPY": "snappy", "GZIP": "gzip", "ZSTD": "zstd", "BROTLI": "brotli"}


def dictionary_page(source, chunk):
    """The values of a chunk's dictionary page as an Arrow array, or None where the dictionary doesn't
    cover the chunk. Only page headers and the dictionary are read."""
    import pyarrow as pa

    kinds = {"INT32": np.int32, "INT64": np.int64, "FLOAT": np.float32, "DOUBLE": np.float64}
    if not chunk.has_dictionary_page or chunk.compression not in CODECS or chunk.physical_type not in (*kinds, "BYTE_ARRAY"):
        return None
    at, end, values = chunk.dictionary_page_offset, chunk.dictionary_page_offset + chunk.total_compressed_size, None
    while at < end:
        size = 1024
        while True:
            try:
                head, used = _struct(memoryview(source.read_at(min(size, end - at), at)))
                break
            except IndexError:  # a header with long statistics
                if size >= end - at:
                    return None
                size *= 8
        if head[1] == DICTIONARY:
            body = source.read_at(head[3], at + used)
            codec = CODECS[chunk.compression]
            body = pa.decompress(body, head[2], codec, asbytes=True) if codec else body
            n = head[7][1]
            if chunk.physical_type == "BYTE_ARRAY":
                texts, i = [], 0
                for _ in range(n):
                    k = int.from_bytes(body[i : i + 4], "little")
                    texts.append(body[i + 4 : i + 4 + k])
                    i += 4 + k
                values = pa.array(texts, pa.binary())
            else:
                values = pa.array(np.frombuffer(body, kinds[chunk.physical_type], n))
        elif head[1] in (DATA, DATA_V2):
            if (head[5][2] if head[1] == DATA else head[8][4]) not in CODED:
                return None  # the dictionary overflowed
        at += used + head[3]
    return values


VALUES = "column string, at string, nulls bigint, s string, l bigint, d double, scanned boolean"
#: Kinds of columns that are profiled chunk by chunk, with the field of VALUES that holds them.
FIELDS = {"string": "s", "byte": "l", "short": "l", "integer": "l", "long": "l", "boolean": "l", "date": "l", "timestamp": "l", "timestamp_ntz": "l", "float": "d", "double": "d"}


def chunk_values(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The distinct values of every column chunk, once per chunk: from the footer where it proves one value,
    from the dictionary page where that covers the chunk, else from the chunk itself, whose nulls are counted too."""

    def typed(values, name: str, to):
        import pyarrow as pa

        if fields[name] == "s":
            return values.cast(pa.binary()).cast(pa.string())
        if fields[name] == "d":
            return values.cast(pa.float64())
        if values.type == pa.bool_():
            return values.cast(pa.int64())
        if pa.types.is_timestamp(to):
            values = values.view(to) if pa.types.is_integer(values.type) else values
            return values.cast(pa.timestamp("us", to.tz), safe=False).view(pa.int64())
        if pa.types.is_date(to):
            return (values if pa.types.is_integer(values.type) else values.view(pa.int32())).cast(pa.int64())
        return values.cast(pa.int64())

    def batch(name: str, values, scanned: tuple[str, int] | None = None):
        """The values of one chunk, and a row of its own for a chunk that was read."""
        import pyarrow as pa

        n, more = len(values), int(scanned is not None)
        columns = {k: pa.nulls(n + more, t) for k, t in schema.items()}
        columns["column"] = pa.array([name] * (n + more), pa.string())
        columns[fields[name]] = pa.concat_arrays([values, pa.nulls(more, values.type)])
        if scanned:
            columns["at"], columns["nulls"], columns["scanned"] = (pa.array([None] * n + [x], schema[k]) for k, x in zip(("at", "nulls", "scanned"), (*scanned, True)))
        return pa.RecordBatch.from_pydict(columns)

    def read(batches):
        import pyarrow.compute as pc

        for b in batches:
            wanted: dict[tuple[str, int], list] = {}
            for path, group, name, nulls, rows in zip(*(c.to_pylist() for c in b.columns)):
                wanted.setdefault((path, group), []).append((name, nulls, rows))
            for (path, group), part in wanted.items():
                f, source = _open(path), _source(path)
                names = [f.metadata.row_group(group).column(i).path_in_schema for i in range(f.metadata.num_columns)]
                for name, nulls, rows in part:
                    if nulls == rows:
                        continue
                    to = f.schema_arrow.field(name).type
                    values = None if nulls is None else dictionary_page(source, f.metadata.row_group(group).column(names.index(name)))
                    if values is not None:
                        yield batch(name, typed(values, name, to))
                        continue
                    column = f.read_row_group(group, columns=[name]).column(0)  # statistics and dictionary are insufficient
                    values = pc.drop_null(pc.unique(column))
                    yield batch(name, typed(values, name, to), (f"{path}:{group}", column.null_count if nulls is None else 0))

    import pyarrow as pa

    schema = {"column": pa.string(), "at": pa.string(), "nulls": pa.int64(), "s": pa.string(), "l": pa.int64(), "d": pa.float64(), "scanned": pa.bool_()}
    return chunks.select("file", "row_group", "column", "nulls", "rows").repartition("file", "row_group").mapInArrow(read, VALUES)


def _bare(table: DataFrame) -> DataFrame:
    """The table as plain files: one that filters, computes or adds columns from paths is written out first,
    so that footers speak of its own rows."""
    plan = table._jdf.queryExecution().optimizedPlan()
    if plan.nodeName().startswith(("LogicalRelation", "Relation")) and plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if not hasattr(relation, "partitionSchema") or relation.partitionSchema().isEmpty():
            return table
    folder = f"{shared_dir(table.sparkSession)}/profiled/{uuid.uuid4().hex}"
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def profile(table: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per column: rows, nulls, null_rate, distinct_count, low, high (as text), violations of its pattern,
    how many chunks there are, how many footers answer for nulls and extrema, and how many were read whole."""
    patterns = patterns or {}
    table = _bare(table)
    kinds = {f.name: f.dataType.typeName() for f in table.schema.fields if isinstance(f.dataType, AtomicType)}
    fields = {c: FIELDS[k] for c, k in kinds.items() if k in FIELDS}
    chunks = footer_chunks(table)
    known = chunks.where(F.col("column").isin(*kinds)).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.count(F.lit(1)).alias("chunk_count"), F.count_if("exact").alias("footer_chunks"),
    )
    bad = F.lit(False)
    for c, p in patterns.items():
        text = F.coalesce("s", F.col("l").cast("string"), F.col("d").cast("string"))
        bad = bad | ((F.col("column") == c) & text.isNotNull() & ~text.rlike(p))
    finite = F.when(~F.isnan("d") & (F.abs("d") != float("inf")), F.col("d"))
    seen = F.col("s").isNotNull() | F.col("l").isNotNull() | F.col("d").isNotNull()
    distinct = chunk_values(chunks.where(F.col("column").isin(*fields)), fields).distinct()
    values = distinct.groupBy("column").agg(
        F.count_if(seen).alias("distinct_count"), F.sum("nulls").alias("counted"), F.count_if("scanned").alias("scanned_chunks"), F.count_if(bad).alias("bad_values"),
        F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("l").alias("l0"), F.max("l").alias("l1"), F.min(finite).alias("d0"), F.max(finite).alias("d1"),
    )

    def shown(i: int) -> Column:
        of = lambda *names: F.col("column").isin([c for c, k in kinds.items() if k in names])
        n = F.col(f"l{i}")
        out = F.when(of("date"), F.date_from_unix_date(n.cast("int")).cast("string")).when(of("timestamp", "timestamp_ntz"), F.timestamp_micros(n).cast("string"))
        return out.when(of("boolean"), (n == 1).cast("string")).when(of("float"), F.col(f"d{i}").cast("float").cast("string")).otherwise(F.coalesce(f"s{i}", n.cast("string"), F.col(f"d{i}").cast("string")))

    out = known.join(values, "column", "left").select("*", shown(0).alias("low"), shown(1).alias("high"))
    for c in [c for c in kinds if c not in fields]:  # decimals and the like have no common order in footers: a scan of their own
        v = F.col(f"`{c}`")
        own = table.select(v.alias("v")).agg(F.countDistinct("v").alias("n"), F.min("v").cast("string").alias("a"), F.max("v").cast("string").alias("b")).first()
        for name, value in (("distinct_count", own["n"]), ("low", own["a"]), ("high", own["b"])):
            out = out.withColumn(name, F.when(F.col("column") == c, F.lit(value)).otherwise(F.col(name)))
    nulls = F.coalesce(F.col("nulls"), F.lit(0)).cast("bigint") + F.coalesce("counted", F.lit(0)).cast("bigint")
    return out.select(
        "column", F.col("rows").cast("bigint").alias("row_count"), nulls.alias("null_count"), (nulls / F.nullif(F.col("rows"), F.lit(0))).alias("null_rate"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), "low", "high", F.coalesce("bad_values", F.lit(0)).alias("pattern_violations"),
        "chunk_count", "footer_chunks", F.coalesce("scanned_chunks", F.lit(0)).alias("scanned_chunks"),
    )


@dataclass(frozen=True)
class Rules:
    """What a load's column must keep to."""

    load: str = "batch_id"
    date: str = "metric_date"
    undated: str = "unknown"
    date_form: str = r"^\d{4}-\d{2}-\d{2}$"
    percentages: tuple[str, ...] = ("rejection_percentage",)
    aside: tuple[str, ...] = ("recorded_at",)
    level_z: float = 6.0
    spread_z: float = 6.0
    least_spread: float = 0.25  # of the usual spread
    variety: float = 0.5  # of the usual share of distinct values
    min_values: int = 5
    reasons: tuple[str, ...] = field(default=("nulls", "impossible", "level", "spread", "variety"))


def _constant(chunks: DataFrame, rules: Rules = Rules()) -> set[str]:
    """Columns that footers prove to hold one possible value and no null: no load of theirs can depart."""
    seen = chunks.groupBy("column").agg(
        F.every("exact").alias("exact"), F.sum("nulls").alias("nulls"), F.min("low").alias("a"), F.max("high").alias("b"), F.max("low").alias("c")
    )
    value = F.col("a").try_cast("double")
    possible = (value >= 0) & (~F.col("column").isin(*rules.percentages) | (value <= 100))
    return {r["column"] for r in seen.where("exact AND nulls = 0 AND a = b AND b = c").where(possible).collect()}


def load_statistics(table: DataFrame, rules: Rules, columns: list[str]) -> DataFrame:
    """Per load and column: n, nulls, impossible, values, distinct_count, level, spread of the dated rows."""
    dated = F.coalesce(F.col(rules.date) != rules.undated, F.lit(True))
    wide = table.select(F.col(rules.load).alias("load"), dated.alias("dated"), *[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    # a row per load: counts and sums, and per column the value counts that give median and distinct values
    parts, long = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        v = F.col(f"v{i}")
        finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
        most = F.lit(100.0 if c in rules.percentages else float("inf"))
        kept = F.when(F.col("dated") & v.isNotNull() & finite, v)
        own = {
            "nulls": F.count_if(v.isNull()), "impossible": F.count_if(v.isNotNull() & (~finite | (v < 0) | (v > most))), "values": F.count(kept), "distinct_count": F.size(F.collect_set(kept)).cast("bigint"),
            "level": F.percentile(kept, F.lit(0.5)), "total": F.sum(kept), "squares": F.sum(kept * kept),
        }
        parts += [x.alias(f"{name}{i}") for name, x in own.items()]
        long.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{i}").alias(name) for name in own]))
    stats = wide.groupBy("load").agg(*parts).select("load", "n", F.inline(F.array(*long)))
    values = F.nullif(F.col("values"), F.lit(0))
    spread = F.sqrt(F.greatest(F.col("squares") / values - F.pow(F.col("total") / values, 2), F.lit(0.0)))
    return stats.withColumn("spread", F.when(values.isNotNull(), spread)).drop("total", "squares")


def departures(stats: DataFrame, rules: Rules) -> DataFrame:
    """Add the reason for which a load's column departs from the other loads'; null: it doesn't."""
    stats = stats.withColumn("share", F.col("distinct_count") / F.nullif(F.col("values"), F.lit(0)))
    enough = F.col("values") >= rules.min_values
    middle = lambda c: F.percentile_approx(F.when(enough, F.col(c)), 0.5)
    usual = stats.groupBy("column").agg(middle("level").alias("u_level"), middle("spread").alias("u_spread"), middle("share").alias("u_share"))
    stats = stats.join(small_side(usual), "column")  # a row per column
    off = stats.groupBy("column").agg(
        F.percentile_approx(F.when(enough, F.abs(F.col("level") - F.col("u_level"))), 0.5).alias("d_level"),
        F.percentile_approx(F.when(enough, F.abs(F.col("spread") - F.col("u_spread"))), 0.5).alias("d_spread"),
    )
    stats = stats.join(small_side(off), "column")
    z = lambda c: F.abs(F.col(c) - F.col(f"u_{c}")) / F.greatest(1.4826 * F.col(f"d_{c}"), 1e-3 * F.abs(F.col(f"u_{c}")), F.lit(1e-9))
    reason = (
        F.when(2 * F.col("nulls") > F.col("n"), "nulls")
        .when(F.col("impossible") > 0, "impossible")
        .when(enough & (z("level") > rules.level_z), "level")
        .when(enough & ((z("spread") > rules.spread_z) & (F.col("spread") > F.col("u_spread")) | (F.col("spread") < rules.least_spread * F.col("u_spread"))), "spread")
        .when(enough & ((F.col("share") < rules.variety * F.col("u_share")) | (F.col("share") * rules.variety > F.greatest(F.col("u_share"), F.lit(0.25)))), "variety")
    )
    return stats.withColumn("reason", reason)


def spoiled(table: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(load, column_name, reason) of columns that a load spoils."""
    numeric = [f.name for f in table.schema.fields if isinstance(f.dataType, NumericType) and f.name not in (rules.load, *rules.aside)]
    constant = _constant(footer_chunks(table), rules)
    columns = [c for c in numeric if c not in constant]
    date = F.col(rules.date)
    real = (date == rules.undated) | (date.rlike(rules.date_form) & date.try_cast("date").isNotNull())
    per_load = table.groupBy(F.col(rules.load).alias("load")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(date.isNull()).alias("nulls"), F.count_if(date.isNotNull() & ~real).alias("bad")
    )
    dates = per_load.select("load", F.lit(rules.date).alias("column_name"), F.when(2 * F.col("nulls") > F.col("n"), "nulls").when(F.col("bad") > 0, "impossible").alias("reason")).where("reason IS NOT NULL")
    if not columns:
        return dates
    # read three times below: a row per load and column, cut off in the shared folder
    stats = checkpointed(load_statistics(table, rules, columns))
    found = departures(stats, rules).where("reason IS NOT NULL")
    return found.select("load", F.col("column").alias("column_name"), "reason").unionByName(dates)
