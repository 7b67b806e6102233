"""Token counts of documents and their sections by offset-mapped attribution.

A document is encoded once, whole. Each token has a span of characters; each section has one as well, and
together the sections cover the document. Tokens are allocated by interval join on the sorted spans. A token
that crosses a boundary goes, by the chosen rule, to the section where it starts ("start"), where it ends
("end") or of which it covers most ("most"; at a tie the earlier). Bytes of one character that are split over tokens
all lie at that character.

Fields are columns that stand before the text, each on a line of its own; the document is then all of them. It is
encoded as a whole too, which is the fields' ids and the text's one after the other where the text begins with no
white space: no match goes from a line feed into what is no white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, RANKS, encode, encoding

RULES = ("start", "end", "most")


def lines(text: str) -> list[int]:
    """Where the sections of a text start: its lines, each with its line feed. An empty text has one section."""
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]


def spans(ids: np.ndarray, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return char[ends - lengths[ids]], char[ends - 1]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; sections start at starts and end where the next begins."""
    a = np.searchsorted(starts, first, "right") - 1
    if rule == "start":
        return a
    b = np.searchsorted(starts, last, "right") - 1
    if rule == "end":
        return b
    out = a.copy()
    for k in np.flatnonzero(a != b):
        cuts = np.clip([*starts[a[k] : b[k] + 1], last[k] + 1], first[k], last[k] + 1)
        out[k] = a[k] + int(np.argmax(np.diff(cuts)))
    return out


def count(text: str | None, enc, lengths: np.ndarray, rule: str, sections: Callable[[str], list[int]] = lines, ids: list[int] | None = None) -> np.ndarray:
    """Tokens of each section of one text; null counts as empty. ids: the text's ids where they are known."""
    text = text or ""
    starts = np.array(sections(text), np.int64)
    ids = np.array(encode(text, enc) if ids is None else ids, np.int64)
    if not len(ids):
        return np.zeros(len(starts), np.int64)
    return np.bincount(attribute(*spans(ids, text, lengths), starts, rule), minlength=len(starts))


def count_fields(fields: list[str | None], text: str | None, enc, lengths: np.ndarray, rule: str, ids: list[int]) -> np.ndarray:
    """Tokens of each field and of the text, which has the given ids; a field's line feed is part of it."""
    text, head = text or "", [f"{f or ''}\n" for f in fields]
    front = "".join(head)
    whole = front + text
    known = [*encode(front, enc), *ids] if text and not text[0].isspace() else encode(whole, enc)
    return count(whole, enc, lengths, rule, lambda _: np.cumsum([0, *map(len, head)]).tolist(), known)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", sections: Callable[[str], list[int]] = lines, ranks: str = RANKS, pattern: str = PATTERN, fields: tuple[str, ...] = ()
) -> DataFrame:
    """docs -> doc_id, n_tokens, n_sections, section_tokens, field_tokens: one row per row, the sections in order.

    n_tokens and section_tokens are those of the text alone; field_tokens those of the document of the named fields
    and the text, one count each, the text last. Null and empty texts have no tokens and one section. Very long texts
    are encoded whole, in pieces; memory grows with the longest text. Rows that repeat or have no id get their own
    results; no rows give no rows. Columns that are not named are not looked at, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        lengths = np.zeros(enc.max_token_value + 1, np.int64)
        for token, rank in enc._mergeable_ranks.items():
            lengths[rank] = len(token)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, by_field = [], []
                for text, own in zip(part.column(1), part.column(2)):
                    text = text.as_py()
                    ids = encode(text, enc)
                    found.append(count(text, enc, lengths, rule, sections, ids))
                    by_field.append(count_fields(own.as_py(), text, enc, lengths, rule, ids) if fields else [len(ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([int(x.sum()) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(by_field, pa.list_(pa.int64()))],
                    ["doc_id", "n_tokens", "n_sections", "section_tokens", "field_tokens"],
                )

    own = F.array(*[F.col(f).cast("string") for f in fields]).cast("array<string>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), own.alias("fields"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, section_tokens array<long>, field_tokens array<long>")
