"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed: whether an n-gram occurs in a text, and whether it does so at least 2 or 4 times. Over a
bounded sample of labelled rows the executors count the texts of each class that have a feature; those whose
log-odds stand out most are scaled by their naive Bayes log-count ratio, and a logistic regression with an
L2 penalty is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample_ids, sample_texts

#: Lengths of the character n-grams.
SIZES = (4, 6, 8)
#: Least occurrences that are features of their own.
TIMES = (1, 2, 4)
#: Hashed features, and those that the model keeps.
WIDTH = 1 << 20
KEPT = 1 << 13
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 2500
THRESHOLD = 0.3
HELD_OUT = (4, 2)
#: Code points looked at once; bounds memory for very long texts.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(WIDTH, np.float32)
        table[self.slots] = self.weights
        return table


def total(table: np.ndarray, text: str | None) -> float:
    """The summed weights of the slots that text has, each once as in fit()."""
    found = features(text)
    return table[np.unique(found[table[found] != 0])].sum(dtype=np.float64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def _most(h: np.ndarray) -> np.ndarray:
    """Sorted hashes, each at most as often as the features tell apart."""
    top = max(TIMES)
    return h[np.concatenate([np.ones(min(top, len(h)), bool), h[top:] != h[:-top]])]


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each length the sorted hashes of the n-grams of codes, each at most max(TIMES) times if codes has several parts.

    Parts are merged once they outweigh what is merged so far, so the work stays about linear.
    """
    merged: list[list[np.ndarray]] = [[] for _ in SIZES]
    for at in range(0, len(codes), AT_ONCE):
        part = codes[at : at + AT_ONCE + max(SIZES) - 1]
        short = len(part) - SIZES[0] + 1
        if short < 1:
            continue
        base = np.full(short, 0x9E3779B1, np.uint32)
        for k in range(SIZES[0]):
            base = (base ^ part[k : short + k]) * np.uint32(0x01000193)
        base = _mix(base)
        for n, held in zip(SIZES, merged):
            more = n - SIZES[0]
            own = min(AT_ONCE, short - more)
            if own < 1:
                continue
            h = np.sort(base[:own] if not more else _mix(base[:own] * np.uint32(2 * n + 1) + base[more : more + own]))
            held.append(h if len(codes) <= AT_ONCE else _most(h))
            if len(held) > 1 and sum(map(len, held[1:])) >= len(held[0]):
                held[:] = [_most(np.sort(np.concatenate(held)))]
    return [held[0] if len(held) == 1 else _most(np.sort(np.concatenate(held))) for held in merged if held]


def features(text: str | None) -> np.ndarray:
    """The slots of the features of text; a slot that several features fall on is there several times.

    An n-gram of 6 or 8 characters is told by its first and last 4.
    """
    line = f" {' '.join((text or '').lower().split())} "
    found = []
    for h in _hashes(np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32)):
        for times in TIMES:
            several = h[times - 1 :][h[times - 1 :] == h[: len(h) - times + 1]] if times > 1 else h
            once = several[np.concatenate([[True], several[1:] != several[:-1]])] if len(several) else several
            found.append((once if times == 1 else _mix(once + np.uint32(times))) & np.uint32(WIDTH - 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class for each slot, summed over a task."""
    sums = np.zeros((2, WIDTH), np.int64)
    for batch in batches:
        for y, text in zip(batch.column(0), batch.column(1)):
            sums[y.as_py(), features(text.as_py())] += 1
    slots = np.flatnonzero(sums.sum(0))
    for at in range(0, len(slots), 1 << 16):
        some = slots[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0, some]), pa.array(sums[1, some])], ["slot", "negative", "positive"])


def fit(slots: np.ndarray, ratio: np.ndarray, y: np.ndarray, found: list[np.ndarray], penalty: float = 3e-5, rounds: int = 200, rate: float = 0.03) -> Model:
    """Fit on positions in slots that each text has. Without rows of both classes the model gives the base rate."""
    if len(y) == 0 or y.min() == y.max() or len(slots) == 0:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(slots[:0], np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    ids = np.concatenate(found).astype(np.int64)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    x = ratio[ids]
    scale = 1 / np.sqrt(max(np.bincount(row, x * x, len(y)).mean(), 1e-9))
    x = x * scale
    n, k = len(y), len(slots)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    w, b, m, v, mb, vb = np.zeros(k), 0.0, np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[ids], n) + b, -30, 30))) - y) * balance
        g, gb = np.bincount(ids, x * error[row], k) + penalty * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        one, two = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / one) / (np.sqrt(v / two) + 1e-8)
        b -= rate * (mb / one) / (np.sqrt(vb / two) + 1e-8)
    return Model(slots, (w * ratio * scale).astype(np.float32), b)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, kept: int = KEPT) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out part.

    The driver gets at most ``kept`` features, and for each sampled row which of those it has.
    """
    ids = sample_ids(labels, "toxic", per_class, *HELD_OUT)
    texts = sample_texts(docs, ids)
    of = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    a, b = of.get(0, 0), of.get(1, 0)
    odds = f"ln((positive + 0.5D) / greatest({b} - positive + 0.5D, 0.5D)) - ln((negative + 0.5D) / greatest({a} - negative + 0.5D, 0.5D))"
    sums = texts.mapInArrow(_counted, "slot int, negative long, positive long").groupBy("slot").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
    marked = sums.filter("negative + positive >= 3").withColumn("z", F.expr(f"abs({odds}) / sqrt(1 / (positive + 0.5D) + 1 / (negative + 0.5D))"))
    chosen = sorted((r.slot, r.negative, r.positive) for r in marked.orderBy(F.desc("z"), "slot").limit(kept).collect())
    table = np.array(chosen, np.int64).reshape(len(chosen), 3)
    slots = table[:, 0]
    negative, positive = table[:, 1] + 1.0, table[:, 2] + 1.0
    ratio = np.log(positive / max(b + 1, 1)) - np.log(negative / max(a + 1, 1))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(slots, features(t.as_py()))).astype("<u2") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in own], pa.binary())], ["y", "has"])

    rows = sorted((r.y, bytes(r.has)) for r in texts.mapInArrow(reduced, "y int, has binary").collect())
    return fit(slots, ratio, np.array([y for y, _ in rows], np.float64), [np.frombuffer(x, "<u2") for _, x in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, held_out, score, predicted: one row per row.

    Null and empty texts are scored by the n-grams of white space alone; very long texts are scored whole. Equal texts have equal
    scores, so rows that repeat have equal results; a null id is not held out. No rows give no rows; other columns,
    whatever their names, are not looked at.
    """
    bias, shared = model.bias, docs.sparkSession.sparkContext.broadcast((model.slots, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Model(*shared.value, bias).table()
        for batch in batches:
            sums = np.array([total(w, t.as_py()) for t in batch.column(2)], np.float64) + bias
            p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, *HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
