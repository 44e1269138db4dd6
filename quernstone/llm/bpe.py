"""Byte-level BPE encoding and decoding by a local rank file.

Method. The tiktoken library with the ranks of a file and the public pattern. Texts longer than `chunk` characters are cut
first, where the pattern can never match across: before a blank or line feed that follows a character that is no white
space. No alternative of the pattern continues from a non-space into white space, and the one look-ahead looks from
white space onwards, which stays whole in the later chunk; so the chunks' ids joined are the whole text's ids. A stretch
without such a place stays one chunk. Decoding joins the tokens' raw bytes and never goes through characters.

A worker keeps one codec a rank file; rows stream through in Arrow batches; nothing is shuffled or broadcast.

Cases. A null text is encoded as the empty one: no ids. Ids that are null decode to null bytes. Repeated rows are encoded
each on its own; an empty table gives no rows. Other columns pass unread; of the same name as an output they are replaced."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

CUT = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str, chunk: int) -> Iterator[str]:
    """The text in chunks of about `chunk` characters, cut at safe places only."""
    start = 0
    while len(text) - start > chunk:
        at = CUT.search(text, start + chunk)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:] if start else text


class Codec:
    def __init__(self, path: str, pattern: str, chunk: int = 1 << 15):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunk = chunk
        self.digits = [str(i).encode() for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.chunk:
            return self.encoding.encode_ordinary(text)
        return [i for piece in pieces(text, self.chunk) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, chunk: int) -> Codec:
    return Codec(path, pattern, chunk)


def _mapped(df: DataFrame, fields: list[tuple[str, str]], each, source: str) -> DataFrame:
    """`df` with `fields` made by each(value of the column `source`) -> a value a field; all batch by batch."""
    names = [n for n, _ in fields]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    at = df.columns.index(source)
    kept = [df.columns.index(c) for c in keep]
    arrow = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[t] for _, t in fields]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [each(v.as_py()) for v in part.column(at)]
                columns = [part.column(i) for i in kept] + [pa.array([m[k] for m in made], t) for k, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return ship(df).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text_col="text", out="ids", chunk=1 << 15) -> DataFrame:
    """`df` with the ids of its texts, and their number in n_tokens."""

    def each(text):
        ids = codec(path, pattern, chunk).encode(text)
        return ids, len(ids)

    return _mapped(df, [(out, "array<int>"), ("n_tokens", "long")], each, text_col)


def decode(df: DataFrame, path: str, pattern: str, ids_col="ids", out="bytes", chunk=1 << 15) -> DataFrame:
    """`df` with the raw bytes that its ids stand for."""
    return _mapped(df, [(out, "binary")], lambda ids: (None if ids is None else codec(path, pattern, chunk).decode(ids),), ids_col)


def round_trip(df: DataFrame, path: str, pattern: str, text_col="text", chunk=1 << 15) -> DataFrame:
    """`df` with n_tokens and digests of the encoded ids and of the bytes decoded from them, without moving the ids."""

    def each(text):
        c = codec(path, pattern, chunk)
        ids = c.encode(text)
        return len(ids), hashlib.sha256(b" ".join(map(c.digits.__getitem__, ids))).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _mapped(df, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], each, text_col)
