"""Byte-level BPE by the tiktoken library with a local rank file.

Long texts are cut before the merges at places where every match of the pattern ends in any case: before an ASCII space or
line feed that follows a letter, a digit or a printable ASCII character. No match crosses such a place, and the look-ahead of
white space never sees beyond it, so the pieces' ids in a row are the ids of the whole text.

The rank file is read by the driver and sent to the workers; a vocabulary's size bounds it.

Defined results: a null text counts as empty and has no ids. Rows that repeat an id or a text are encoded each by itself. Other
columns pass through, whatever their names; a column named like the made one is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_made

#: Characters from which a text is cut, and of a piece at least.
PIECE_CHARS = 50_000
#: A rank file beyond this is no vocabulary.
MOST_RANK_BYTES = 32_000_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has more than {MOST_RANK_BYTES} bytes")
    return data


def encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, least: int = PIECE_CHARS) -> Iterator[str]:
    """The text, cut at safe places only."""
    start = 0
    while len(text) - start > least:
        at = start + least
        while True:
            spots = [x for x in (text.find(" ", at), text.find("\n", at)) if x >= 0]
            if not spots:
                break
            at = min(spots)
            before = text[at - 1]
            if before.isalnum() or "!" <= before <= "~":
                break
            at += 1
        if not spots:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encode_text(encoder: tiktoken.Encoding, text: str | None) -> list[int]:
    ids: list[int] = []
    for piece in pieces(text or ""):
        ids += encoder.encode_ordinary(piece)
    return ids


def _with_column(df: DataFrame, source: str, made: str, kind: T.DataType, arrow: pa.DataType, rank_data: bytes, pattern: str, function) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(rank_data)

    def maker():
        encoder = encoding(sent.value, pattern)
        return lambda values: [pa.array([function(encoder, x) for x in values], arrow)]

    return with_made(df, source, T.StructType([T.StructField(made, kind)]), maker, at_once=50)  # ids take several times the room of their text


def bpe_encode(docs: DataFrame, rank_data: bytes, pattern: str, made: str = "ids") -> DataFrame:
    """``docs`` (text, ...) with the ids of its texts, without special tokens."""
    return _with_column(docs, "text", made, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), rank_data, pattern, encode_text)


def bpe_decode(tokens: DataFrame, rank_data: bytes, pattern: str, source: str = "ids", made: str = "decoded") -> DataFrame:
    """``tokens`` with the raw bytes of its ids; a null list gives no bytes."""
    return _with_column(tokens, source, made, T.BinaryType(), pa.binary(), rank_data, pattern, lambda encoder, ids: encoder.decode_bytes(ids or []))
