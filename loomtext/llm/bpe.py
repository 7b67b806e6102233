"""Byte-level BPE with the tiktoken library and a local file of ranks.

Long texts are encoded in pieces. A piece ends between a character that is no white space and a white-space
character: no match of the pre-splitting pattern goes across such a place (white space stands only at the start
of a match or makes up all of it) and what follows is matched as if it stood alone. A long run of white space is
one match but for its last character, which goes with what follows (at the end of a text the whole run is one
match); it is merged as one piece, without the pattern, whose search would go too deep. A long text without white
space is not cut. The four separators U+001C to U+001F are white space to Python, not to the pattern.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters after which the next safe place ends a piece.
PIECE = 1 << 15
#: White-space characters in a row that are merged apart from the pattern.
BLANKS = 1 << 10
_SAFE = re.compile(r"(?<=\S)(?=[^\S\x1C-\x1F])|(?<=[\x1C-\x1F])(?=[^\S\x1C-\x1F])")
_BLANK = r"[^\S\x1C-\x1F]{%d,}"


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file: one base64 token and its rank a line."""
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text cut at safe places, each piece the shortest of more than size characters."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str | None, enc: tiktoken.Encoding, blanks: int = BLANKS) -> list[int]:
    """The ids of a text without special tokens; null counts as empty."""
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for run in re.finditer(_BLANK % blanks, text):
        for piece in pieces(text[at : run.start()]):
            ids += enc.encode_ordinary(piece)
        at = run.end() - (run.end() < len(text))
        ids += enc._encode_single_piece(text[run.start() : at]) if at > run.start() else []
    for piece in pieces(text[at:]):
        ids += enc.encode_ordinary(piece)
    return ids


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    """The bytes of ids; they need not be whole characters."""
    return enc.decode_bytes(ids)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """docs -> (doc_id, ids, decoded): the ids as little-endian unsigned 32-bit integers, and their bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t.as_py(), enc) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary()), pa.array([decode(i, enc) for i in ids], pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """docs -> doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row.

    Null and empty texts have no tokens and the digests of no bytes. Very long texts are encoded whole, in pieces.
    Rows that repeat or have no id get their own results. No rows give no rows. Other columns, whatever their
    names, are not looked at.
    """
    coded = tokenize(docs, id_col, text_col, ranks, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
