"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / size-of-source times. The whole part is certain; the
fractional parts are copy probabilities. In pairs, words are moved from one side to the other at random until
one of the two probabilities is 0 or 1: what one side gains in expected words the other loses, so the source's
expected words stay what they are, every document's expected copies too, and only one document of a source is
left with a fraction.

Within a block documents are paired from the largest down. A document so large that all smaller ones could not
settle it pair by pair (its square is above the sum of theirs) is paired with their pool, whose common probability
takes the difference. The document that is left open is handed up, and those of many blocks are paired one
with one, in a tree of blocks of blocks. Rows alike in id, source, size and text are one unit: between equals
pairing leaves floor(n * p) of them taken and one open. All chance comes from hashes, so reruns agree.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, partitions

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents of a block, about, and blocks that are combined by one node of the tree.
BLOCK = 2048
FAN_IN = 256
SEED = 20


KEY = ("doc_id", "source", "size", "mark")


def _key(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """The columns that tell units apart; mark is a hash of the text."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return {"doc_id": F.col(id_col).cast("long"), "source": F.col(source_col).cast("string"), "size": size, "mark": F.xxhash64(text)}


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs -> (doc_id, source, size, mark, n): units of n rows alike; size is the number of words, 0 for null."""
    rows = docs.select(*[c.alias(k) for k, c in _key(id_col, text_col, source_col).items()])
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size, n) -> (source, n_docs, source_size, target).

    Sources in code point order, null last, get the weights in turn and share ``share`` of all sizes. A target
    stops at ``most`` times its source's size; the excess is shared anew by weight until none is above. This
    is a common level: target = least(most * size, weight * level). The level is found by a few sums over the
    table of sources, which has one row per source and is numbered in one streaming task.
    """
    table = sizes.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = cut(table.withColumn("weight", weight))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("weight") * F.lit(level) >= most * F.col("source_size")
        row = table.agg(F.sum(F.when(capped, most * F.col("source_size")).otherwise(0.0)).alias("full"), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not row.open:
            break
        now = (share * total - row.full) / row.open
        if now <= level * (1 + 1e-12):
            break
        level = now
    return table.select("source", "n_docs", "source_size", F.least(most * F.col("source_size"), F.col("weight") * F.lit(level)).alias("target"))


def _chance(*values: int) -> float:
    return xxhash.xxh64_intdigest(b",".join(b"%d" % v for v in values), SEED) / 2.0**64


def _whole(p: float) -> bool:
    return p <= 1e-9 or p >= 1 - 1e-9


def _moved(p: float, room_up: float, room_down: float, size: int, chance: float) -> float:
    """Words that a document of size and probability p gains (or loses) from a partner that has room_up words to
    give and room_down to take."""
    up, down = min((1 - p) * size, room_up), min(p * size, room_down)
    return up if chance * (up + down) < down else -down


def settle(ids: list[int], sizes: list[int], p: list[float]) -> tuple[list[int], int]:
    """Round probabilities p, each document paired with the one left open before it; returns 0 or 1 for each, and
    the place still open or -1.

    p of the open place is left in p. Sizes are positive.
    """
    out, open_at = [0] * len(p), -1
    for j in range(len(p)):
        if _whole(p[j]):
            out[j] = int(p[j] > 0.5)
            continue
        if open_at < 0:
            open_at = j
            continue
        i, a, b, q = open_at, sizes[open_at], sizes[j], p[j]
        move = _moved(p[i], q * b, (1 - q) * b, a, _chance(ids[i], ids[j], j))
        p[i], p[j] = p[i] + move / a, q - move / b
        open_at = -1
        for k in (i, j):
            if _whole(p[k]):
                out[k] = int(p[k] > 0.5)
            else:
                open_at = k
    return out, open_at


def settle_even(ids: list[int], sizes: list[int], p: float) -> tuple[list[int], int, float]:
    """Round documents that all have probability p, largest first; returns 0 or 1 for each, the place still open
    or -1, and its probability. Sizes are positive and fall.

    The open document is paired with the next one, or, if its square is above the sum of the squares of all that
    follow, with the pool of these.
    """
    n = len(ids)
    words = np.append(np.cumsum(np.array(sizes[::-1], np.float64))[::-1], 0.0).tolist()
    squares = np.append(np.cumsum(np.array(sizes[::-1], np.float64) ** 2)[::-1], 0.0).tolist()
    out, i, own, j = [0] * n, 0, p, 1
    while j < n:
        if _whole(p):
            out[j:] = [int(p > 0.5)] * (n - j)
            break
        if _whole(own):
            out[i], i, own, j = int(own > 0.5), j, p, j + 1
            continue
        a = sizes[i]
        if float(a) * a > squares[j]:
            move = _moved(own, p * words[j], (1 - p) * words[j], a, _chance(ids[i], j))
            own, p = own + move / a, p - move / words[j]
            continue
        b = sizes[j]
        move = _moved(own, p * b, (1 - p) * b, a, _chance(ids[i], ids[j], j))
        own, other = own + move / a, p - move / b
        if _whole(other):
            out[j] = int(other > 0.5)
        else:
            out[i], i, own = int(own > 0.5), j, other
        j += 1
    if i < n and not _whole(own):
        return out, i, own
    if i < n:
        out[i] = int(own > 0.5)
    return out, -1, 0.0


_SCHEMA = "unit long, doc_id string, source string, size long, mark long, n long, source_size long, target double, block long, base long, p double, extra long, is_open boolean"


def _round(group: pd.DataFrame) -> pd.DataFrame:
    """One node of the tree: all units of a block, extra raised by 1 for those rounded up, but for the one that stays open."""
    group = group.sort_values(["size", "unit"], ascending=False, kind="stable").reset_index(drop=True)
    left, extra = group["p"].to_numpy(np.float64).copy(), group["extra"].to_numpy(np.int64).copy()
    ids, sizes, is_open = group["unit"].tolist(), group["size"].tolist(), np.zeros(len(group), bool)
    even = np.flatnonzero(group["n"].to_numpy() == 1)
    even = even if len(even) and left[even].min() == left[even].max() else even[:0]
    odd = np.setdiff1d(np.arange(len(group)), even)
    open_at = []
    if len(even):
        done, at, kept = settle_even([ids[k] for k in even], [sizes[k] for k in even], float(left[even[0]]))
        extra[even] += done
        if at >= 0:
            left[even[at]] = kept
            open_at.append(even[at])
    odd = np.sort(np.concatenate([odd, np.array(open_at, odd.dtype)]))
    if len(odd):
        p = left[odd].tolist()
        done, at = settle([ids[k] for k in odd], [sizes[k] for k in odd], p)
        extra[odd] += done
        if at >= 0:
            left[odd[at]], is_open[odd[at]] = p[at], True
    return group.assign(extra=extra, is_open=is_open, p=left)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """docs -> doc_id, source, size, mark, n, source_size, target, base, extra: one row per unit of n rows alike.

    Each of the n rows is taken base times, and extra of them once more. Units without words are never rounded up
    and take no part in the blocks, however many they are. No rows give no rows.
    """
    sizes = cut(sized(docs, id_col, text_col, source_col))
    aim = cut(targets(sizes))
    blocks = F.ceil(F.col("n_docs") / block).cast("long")
    wide = int(aim.agg(F.max(blocks)).first()[0] or 1)
    aim = aim.withColumn("blocks", blocks).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-9)
    share = F.greatest(rate - whole, F.lit(0.0))
    unit = F.xxhash64(*KEY, F.lit(SEED))
    rows = sizes.join(aim, sizes["source"].eqNullSafe(aim["of"])).select(
        unit.alias("unit"), F.col("doc_id").cast("string").alias("doc_id"), *KEY[1:], "n", "source_size", "target", F.pmod(unit, F.col("blocks")).alias("block"), whole.cast("long").alias("base"), share.alias("p"),
    )
    rows = rows.withColumn("extra", F.when(F.col("size") > 0, F.when(F.col("n") > 1, F.floor(F.col("n") * F.col("p") + 1e-9)).otherwise(0)).otherwise(0).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("n") > 1, F.greatest(F.col("n") * F.col("p") - F.col("extra"), F.lit(0.0))).otherwise(F.col("p"))).withColumn("is_open", F.lit(True))
    done = [rows.filter("size = 0")]
    rows = rows.filter("size > 0")
    for level in range(1 + max(0, math.ceil(math.log(wide, FAN_IN) - 1e-9))):
        if level:
            rows = rows.withColumn("block", F.expr(f"block div {FAN_IN}"))
        rounded = cut(rows.groupBy("source", "block").applyInPandas(_round, _SCHEMA))
        done.append(rounded.filter("not is_open"))
        rows = rounded.filter("is_open")
    last = (F.pmod(F.xxhash64("unit", F.lit(SEED + 1)), F.lit(1 << 30)) / float(1 << 30) < F.col("p")).cast("long")
    out = rows.withColumn("extra", F.col("extra") + last)
    for part in done:
        out = out.unionByName(part)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *KEY[1:], "n", "source_size", "target", "base", "extra")


#: Rows alike that one row of a plan is spread out to at once.
SPREAD = 4096


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """docs -> doc_id, source, size, source_size, target, copies: one row per row.

    copies is how often the row is taken: 0, 1 or 2 at the default limits. Null and empty texts have size 0.
    Rows that repeat an id or have none are rounded like any other; of rows wholly alike as many are taken as
    their sum of probabilities says, the first of them. Very long texts are one document like any other. Other
    columns are not looked at. No rows give no rows.
    """
    units = cut(plan(docs, id_col, text_col, source_col, block))
    keep = ["doc_id", "source", "size", "source_size", "target"]
    lone = units.filter("n = 1").select(*keep, (F.col("base") + F.col("extra")).alias("copies"))
    many = units.filter("n > 1")
    if many.isEmpty():
        return lone
    parts = many.withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {SPREAD}L)")))
    parts = parts.repartition(partitions(docs.sparkSession), *KEY, "at")
    rows = parts.withColumn("nth", F.explode(F.expr(f"sequence(at, least(n, at + {SPREAD}) - 1)")))
    return lone.unionByName(rows.select(*keep, (F.col("base") + (F.col("nth") < F.col("extra")).cast("long")).alias("copies")))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row there as often as the mix takes it; the columns are those of docs, their names free.

    Rows alike in id, source, size and text are numbered within the partition of docs that holds them, so a unit
    of very many rows is spread over as many tasks as it came in.
    """
    key = {k: free_name(docs, k) for k in KEY}
    n, copies, turn, part, before, extra = (free_name(docs, k) for k in ("n", "copies", "turn", "part", "before", "extra"))
    units = cut(plan(docs, id_col, text_col, source_col)).withColumnsRenamed(key).select(*key.values(), F.col("n").alias(n), F.col("base").alias(copies), F.col("extra").alias(extra))
    keyed = docs.withColumns({key[k]: c for k, c in _key(id_col, text_col, source_col).items()})
    times = F.explode(F.expr(f"sequence(1L, {copies})")).alias(turn)

    def met(rows: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        own = right.withColumnsRenamed({k: f"{k}_" for k in on})
        same = [rows[k].eqNullSafe(own[f"{k}_"]) for k in on]
        return rows.join(own, reduce(lambda a, b: a & b, same)).drop(*[f"{k}_" for k in on])

    on = list(key.values())
    if units.filter(F.col(n) > 1).isEmpty():
        lone = units.select(*on, (F.col(copies) + F.col(extra)).alias(copies)).filter(F.col(copies) > 0)
        return met(keyed, lone, on).select(*[F.col(c) for c in docs.columns], times).drop(turn)
    keyed = cut(keyed.withColumn(part, F.spark_partition_id()))
    held = keyed.groupBy(*on, part).agg(F.count("*").alias(n))
    held = met(held.withColumn(before, F.sum(n).over(Window.partitionBy(*on).orderBy(part)) - F.col(n)).drop(n), units.drop(n), on)
    numbered = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(*on, part).orderBy(F.lit(0))))
    taken = F.col(copies) + (F.col(before) + F.col(turn) <= F.col(extra)).cast("long")
    placed = met(numbered, held, [*on, part]).withColumn(copies, taken).drop(turn)
    return placed.filter(F.col(copies) > 0).select(*[F.col(c) for c in docs.columns], times).drop(turn)
