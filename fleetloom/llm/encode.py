"""The whole corpus as token ids of a public byte-level tokenizer (problem 8).

Texts pass through the tokenizers library in Arrow batches. Spans are kept both
as characters and as bytes of the text; decoding reverses the table that maps
bytes to printable characters, so that a character split over tokens comes back
whole and a span cut inside one is marked.

Defined cases: a null or empty text has the empty list; strings of special
tokens inside a text are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetloom.functions.streams import slices
from fleetloom.session import spread

#: Folder of the vocabulary files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(key, ids) with one row per document."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for b in slices(batches):
            ids = [e.ids for e in t.encode_batch_fast([x or "" for x in b.column(1).to_pylist()], add_special_tokens=False)]
            flat = pa.array([i for x in ids for i in x], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, ids))], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return spread(documents.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(key, ids, char_starts, char_ends, byte_starts) of each document.

    A token that holds part of a character spans the whole character in
    characters; its byte start tells the parts apart.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for b in slices(batches):
            rows = []
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                e = t.encode(part or "", add_special_tokens=False)
                widths = [len(token_bytes(t, i)) for i in e.ids]
                rows.append((k, e.ids, [a for a, _ in e.offsets], [z for _, z in e.offsets], [0, *accumulate(widths)][:-1] if widths else []))
            ints = pa.list_(pa.int32())
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), b.schema.field(0).type), *(pa.array(list(c), ints) for c in cols[1:])], names=[key, "ids", "char_starts", "char_ends", "byte_starts"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, char_starts array<int>, char_ends array<int>, byte_starts array<int>")


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(t, token_id: int) -> bytes:
    table = byte_of_char()
    return bytes(table[c] for c in t.id_to_token(token_id))


def decode_ids(ids: list[int] | None, path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> str:
    """The text of the ids; bytes of a character cut at an end become U+FFFD."""
    t = tokenizer(path)
    return b"".join(token_bytes(t, i) for i in ids or []).decode("utf-8", errors="replace")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(key, text) back from (key, ids)."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            texts = [decode_ids(x, path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
