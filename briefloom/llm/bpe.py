"""Byte-level BPE encoding and decoding of whole texts with tiktoken and a local rank file.

A text is cut at safe boundaries, places where the split pattern always ends a match, so every piece encodes to the
same ids as inside the whole text and memory stays bounded by the piece. Decoding works on raw bytes, because a piece
or a token may end inside a character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.shared import in_batches

PIECE = 1 << 16  # characters per encoding call
# A printable character before a blank or line break always ends a match: no alternative of the pattern spans it.
SAFE = regex.compile(r"(?<=[!-~\p{L}\p{N}])(?=[ \n])")
_LOADED: dict = {}


def encoding(path: str, pattern: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive parts of ``text``, each cut at the first safe boundary after ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def encode(tokenizer, text: str, size: int = PIECE) -> np.ndarray:
    parts = [np.asarray(tokenizer.encode_ordinary(p), dtype="<u4") for p in pieces(text, size)]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def decode(tokenizer, ids: np.ndarray) -> bytes:
    return tokenizer.decode_bytes(ids.tolist())


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
             decoded: str | None = None) -> DataFrame:
    """Every row with its token ids (``array<int>``), and with the decoded bytes where ``decoded`` names a column.

    A null text counts as empty: no ids, no bytes. Other columns pass through; an existing column called ``ids`` or
    ``decoded`` is replaced. An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c not in (ids, decoded)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + [f"`{ids}` array<int>"] +
                       ([f"`{decoded}` binary"] if decoded else []))
    place = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [encode(tokenizer, t or "") for t in part.column(place).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                flat = np.concatenate(rows).view("<i4")
                columns = [*part.columns, pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))]
                names = [*rest, ids]
                if decoded:
                    columns.append(pa.array([decode(tokenizer, r) for r in rows], pa.binary()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*rest).transform(in_batches, run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids as little-endian 32-bit integers and of the decoded bytes.

    Null text: the empty text. A null or repeated key gives a row of its own like any other.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path, pattern)
        for batch in batches:
            n, first, second = [], [], []
            for value in batch.column(1):
                ids, raw = hashlib.sha256(), hashlib.sha256()
                count = 0
                for part in pieces(value.as_py() or ""):
                    got = np.asarray(tokenizer.encode_ordinary(part), dtype="<u4")
                    count += len(got)
                    ids.update(got.tobytes())
                    raw.update(decode(tokenizer, got))
                n.append(count)
                first.append(ids.hexdigest())
                second.append(raw.hexdigest())
            columns = [pa.array(v, t) for v, t in zip((n, first, second), out.types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *out.names])

    return (docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
            .transform(in_batches, run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
