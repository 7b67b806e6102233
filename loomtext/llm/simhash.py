"""SimHash near-duplicates by a byte-position index with count filtering.

Fingerprints of 64 bits within 2 bits of each other differ in at most 2 of their 8 bytes: they share at least 6
positional bytes. So some 4 positions that they share lie among the first 6, and the inverted index posts each
fingerprint under its bytes at every choice of START = 4 positions whose last one has at most 2 others left out
before it (15 postings). A posting list that is longer than ``list_size`` is split by the byte at one further
position, then by one more: its members are posted anew under 5, and under 6 positions by the same rule. Each pair that
meets in a list gets the tally of its shared positional bytes; those with the least number, 6, are retained and
verified by their differing bits. Equal fingerprints are one entry, however many documents carry them.

Lists under 6 positions hold fingerprints that have the least number already and differ in two bytes alone. Where
such a list is still too long to pair off, two of its members lie within 2 bits just if some value is within 1
bit of both: each is filed under the 17 values within 1 bit of its two free bytes, and all under one value (17 at
most, all within 2 bits of each other) are linked to the first. This yields the same components from a linear number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .components import components

WORDS = 3
BITS = 2
SEED = 42
POSITIONS = 8
#: Positional bytes that fingerprints within BITS bits share at least, and those of the first postings.
LEAST = POSITIONS - BITS
START = 4
#: Longest posting list whose pairs are tallied one by one.
LIST_SIZE = 64
#: Shingles whose bits are counted at once; bounds memory for very long texts.
AT_ONCE = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text as an unsigned integer; no words: 0."""
    tokens = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(tokens))
    first, last = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), AT_ONCE):
        some = [digest(line[a:b], SEED) for a, b in zip(first[at : at + AT_ONCE], last[at : at + AT_ONCE])]
        bits = np.unpackbits(np.array(some, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(values.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, fp): one row per row, fp the signed form of the 64 bits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _choices(k: int) -> list[tuple[int, ...]]:
    """The k positions that can be the first k shared ones of two fingerprints that share LEAST at least."""
    return [c for c in combinations(range(POSITIONS), k) if c[-1] - (k - 1) <= BITS]


def _byte(x: str, p: int) -> str:
    return f"(shiftrightunsigned({x}, {8 * p}) & 255L)"


def _postings(entries: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """entries (fp) -> (slot, key, fp): the bytes of fp at k positions; slot numbers the choice of positions.

    within: entries have a column of that name, the number of a choice of k - 1 positions; only choices that begin with it are made.
    """
    before = {c: i for i, c in enumerate(_choices(k - 1))}
    rows = []
    for slot, c in enumerate(_choices(k)):
        key = " | ".join(f"shiftleft({_byte('fp', p)}, {8 * i})" for i, p in enumerate(c))
        row = f"struct({slot} as slot, {key} as key)"
        rows.append(row if within is None else f"if({within} = {before[c[:-1]]}, {row}, null)")
    return entries.select("fp", F.expr(f"inline(filter(array({', '.join(rows)}), x -> x is not null))")).select("slot", "key", "fp")


def _tally(x: str, y: str) -> str:
    """SQL for the number of positional bytes that two fingerprints share."""
    return " + ".join(f"if({_byte(f'({x} ^ {y})', p)} = 0L, 1, 0)" for p in range(POSITIONS))


def _paired(lists: DataFrame, bits: int) -> DataFrame:
    """lists (slot, key, fp) -> (u, v): pairs of a list that share LEAST positional bytes at least, verified."""
    tallied = f"filter(transform(slice(m, i + 2, size(m)), y -> struct(y as v, {_tally('x', 'y')} as shared)), z -> z.shared >= {LEAST})"
    pairs = f"flatten(transform(m, (x, i) -> transform({tallied}, z -> struct(x as u, z.v as v))))"
    met = lists.groupBy("slot", "key").agg(F.collect_list("fp").alias("m")).filter("size(m) > 1")
    return met.select(F.expr(f"inline({pairs})")).filter(f"bit_count(u ^ v) <= {bits}")


def _starred(lists: DataFrame) -> DataFrame:
    """lists (slot, key, fp) under LEAST positions -> (u, v): members within 1 bit of one value, linked to the least."""
    free = {i: [p for p in range(POSITIONS) if p not in c] for i, c in enumerate(_choices(LEAST))}
    rest = "case slot " + " ".join(f"when {i} then {_byte('fp', a)} | shiftleft({_byte('fp', b)}, 8)" for i, (a, b) in free.items()) + " end"
    near = f"concat(array({rest}), transform(sequence(0, 15), b -> ({rest}) ^ shiftleft(1L, b)))"
    met = lists.select("slot", "key", "fp", F.explode(F.expr(near)).alias("value")).groupBy("slot", "key", "value").agg(F.collect_list("fp").alias("m"))
    return met.filter("size(m) > 1").select(F.expr("inline(transform(m, x -> struct(array_min(m) as u, x as v)))")).filter("u <> v")


def links(entries: DataFrame, bits: int = BITS, list_size: int = LIST_SIZE) -> DataFrame:
    """entries (fp), distinct -> edges (u, v) that connect just the fingerprints within 2 bits."""
    if bits != BITS:
        raise ValueError("the index is laid out for fingerprints within 2 bits")
    out, postings = None, _postings(entries, START)
    for k in range(START, LEAST + 1):
        long_lists = postings.groupBy("slot", "key").count().filter(F.col("count") > list_size).select("slot", "key", F.lit(True).alias("long"))
        dealt = cut(postings.join(long_lists, ["slot", "key"], "left"))
        found = _paired(dealt.filter("long is null"), bits)
        out = found if out is None else out.unionByName(found)
        hot = dealt.filter("long").select("slot", "key", "fp")
        if hot.isEmpty():
            return out
        if k == LEAST:
            return out.unionByName(_starred(hot))
        postings = _postings(hot.withColumnRenamed("slot", "of"), k + 1, "of")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_size: int = LIST_SIZE) -> DataFrame:
    """docs -> (doc_id, fp, component_id), one row per row of docs.

    component_id is the least doc_id reachable over links of 2 bits or fewer. Null and empty texts have
    fingerprint 0 and are linked like any other. A null doc_id keeps its row and is never a component_id
    (null if no row of the component has an id). Repeated rows get equal results. No rows give no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    rooted = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), list_size)
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = cut(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def _rooted(entries: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """entries (fp, rep), fp distinct -> (fp, rep, root): root is the same just for the fingerprints of a component."""
    entries = cut(entries)
    roots = components(links(entries.select("fp"), list_size=list_size))
    return entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's columns; equal rows have equal keys. Columns of maps, which have no hash, are left out."""
    columns = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and docs.schema[c].dataType.simpleString() != "variant"]
    values = [x for c in columns for x in (docs[c].isNull(), docs[c])]
    return F.xxhash64(*values), F.xxhash64(F.lit(SEED), *values)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least id; the columns are those of docs.

    Rows without an id come after those with one. Among rows with one id, or none, the hash of the row decides, and
    of wholly equal rows a single one stays. Texts that are no near-duplicates stay apart, also under one id.
    """
    high, low, n = (free_name(docs, x) for x in ("high", "low", "n"))
    h, l = _row_key(docs)  # noqa: E741
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), h.alias("h"), l.alias("l"))
    prints = cut(rows.mapInArrow(_fingerprints, "doc_id long, h long, l long, fp long").groupBy("fp", "h", "l").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", "l", "n"))
    rooted = _rooted(prints.groupBy("fp").agg(best.alias("rep")))
    chosen = cut(rooted.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.h").alias(high), F.col("rep.l").alias(low), F.col("rep.n").alias(n)))
    keyed = docs.withColumns({high: h, low: l})
    kept = keyed.join(chosen, [high, low])
    out = kept.filter(F.col(n) == 1)
    if not chosen.filter(F.col(n) > 1).isEmpty():
        out = out.unionByName(kept.filter(F.col(n) > 1).dropDuplicates([high, low]))
    return out.select(*docs.columns)
