"""Reading sorted partitions as a stream of groups, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


LIMIT = 1_000_000


def groups(batches: Iterator[pa.RecordBatch], keys: int, limit: int = LIMIT) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, other columns as arrays) for each run of equal leading ``keys`` columns.

    The input is sorted by them; a group that ends a batch waits for the next one.
    A group of more than ``limit`` rows comes in parts, cut where its first other
    column changes, so that memory stays bounded.
    """
    held_key: tuple | None = None
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(n, dtype=bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in cols[:keys])
            part = [c[a:b] for c in cols[keys:]]
            if key != held_key:
                if held_key is not None:
                    yield held_key, [np.concatenate(x) for x in zip(*held)]
                held_key, held, size = key, [], 0
            held.append(part)
            size += b - a
            if size > limit:
                whole = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1 if (whole[0] != whole[0][-1]).any() else 0
                if cut:
                    yield key, [x[:cut] for x in whole]
                held, size = [[x[cut:] for x in whole]], size - cut
    if held_key is not None:
        yield held_key, [np.concatenate(x) for x in zip(*held)]


def record_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Tuples to batches of bounded size."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of texts a few rows at a time, so that Python holds few long texts at once."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
