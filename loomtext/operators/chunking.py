"""Token-bounded chunks of documents with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .documents import tokens

PRESETS = {"4K tokens": 4_000, "8K tokens": 8_000, "16K tokens": 16_000}


def pack(parts: list[str], most: int) -> list[str]:
    """Parts joined by blank lines while their tokens fit; a part that is too long stands alone."""
    out: list[list[str]] = []
    size = 0
    for part in parts:
        n = tokens(part)
        if out and size + n <= most:
            out[-1].append(part)
            size += n
        else:
            out.append([part])
            size = n
    return ["\n\n".join(x) for x in out]


def split(text: str, most: int) -> list[str]:
    """Chunks at first- and second-level headings; a section too long for one is packed by paragraphs."""
    at = [m.start() for m in re.finditer(r"^#{1,2}\s+", text, re.M)]
    if not at:
        return pack(re.split(r"\n\n+", text), most)
    out, waiting = [], [text[: at[0]].strip()] if text[: at[0]].strip() else []
    for a, b in zip(at, [*at[1:], len(text)]):
        section = text[a:b]
        if tokens(section) > most:
            out += pack(waiting, 1 << 62) if waiting else []
            out += pack(re.split(r"\n\n+", section), most)
            waiting = []
        elif sum(map(tokens, waiting)) + tokens(section) > most:
            out += pack(waiting, 1 << 62) if waiting else []
            waiting = [section]
        else:
            waiting.append(section)
    return out + (pack(waiting, 1 << 62) if waiting else [])


def tail(text: str, most: int) -> str:
    """The longest run of last paragraphs whose tokens fit."""
    parts, n = text.split("\n\n"), 0
    k = len(parts)
    while k and n + tokens(parts[k - 1]) <= most:
        k -= 1
        n += tokens(parts[k])
    return "\n\n".join(parts[k:])


def chunks(text: str, most: int, overlap: int | None = None, strict: bool = False) -> list[str]:
    """Chunks of a text; each but the first begins with the tail of the one before. strict: cut what is still too long."""
    if not text:
        return []
    if most <= 0 or tokens(text) <= most:
        return [text]
    overlap = most // 10 if overlap is None else overlap
    raw = [c for c in split(text, most) if c.strip()]
    if strict:
        raw = [c[k : k + 4 * most] for c in raw for k in range(0, len(c), 4 * most)]
    if overlap <= 0:
        return raw
    return raw[:1] + [f"{t}\n\n{c}" if (t := tail(p, overlap)) else c for p, c in zip(raw, raw[1:])]


def check(most: int, overlap: int | None) -> None:
    if not 0 < most <= 128_000:
        raise ValueError("max_tokens must be above 0 and at most 128000")
    if overlap is not None and overlap < 0:
        raise ValueError("overlap must not be below 0")


def chunk(docs: DataFrame, max_tokens: int, overlap: int | None = None, key: str = "doc_id", content: str = "content", strict: bool = False) -> DataFrame:
    """docs -> (doc_id, chunk_idx, chunk, n_tokens)."""
    check(max_tokens, overlap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([chunks(t or "", max_tokens, overlap, strict) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "chunks"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(content).cast("string").alias("content"))
    out = rows.mapInArrow(work, "doc_id long, chunks array<string>").select("doc_id", F.posexplode("chunks").alias("chunk_idx", "chunk"))
    return out.withColumn("n_tokens", T.tokens(F.col("chunk")))


def paragraph_pack(docs: DataFrame, max_tokens: int, parts: str = "parts") -> DataFrame:
    """docs with ``chunk_starts``: the parts at which chunks start when parts are packed greedily. A fold in SQL."""
    n = T.tokens
    fold = F.aggregate(
        F.transform(F.col(parts), lambda x, i: F.struct(n(x).alias("n"), i.alias("i"))),
        F.struct(F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("starts")),
        lambda s, x: F.when((F.size(s["starts"]) > 0) & (s["size"] + x["n"] <= max_tokens), F.struct((s["size"] + x["n"]).alias("size"), s["starts"].alias("starts"))).otherwise(
            F.struct(x["n"].alias("size"), F.concat(s["starts"], F.array(x["i"])).alias("starts"))
        ),
        lambda s: s["starts"],
    )
    return docs.withColumn("chunk_starts", fold)


def overlap_for(most: int, percent: float) -> int:
    """Overlap tokens for a percentage of the chunk size."""
    return round(most * percent / 100)
