"""Quality: a generalised additive model with pairwise interactions on document statistics.

Cyclic boosting goes round the features, each time fitting one shallow tree to the log-loss gradient over the
feature's bins and adding a small step to the feature's lookup table; afterwards the same is done for the
pairs of features with the largest remaining gain. A score is the sum of one bin of each table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample_ids, sample_texts
from .rules import STOP_WORDS

#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 2500
THRESHOLD = 0.5
HELD_OUT = (3, 1)
BINS = 32
PAIR_BINS = 8
PAIRS = 6
NAMES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "exclamation_share", "punctuation_share",
    "stop_share", "distinct_share", "top_word_share", "repeated_windows", "repeated_lines", "words_a_line", "stops_a_word",
)
_STOP = frozenset(w.encode() for w in STOP_WORDS)
#: Kinds of bytes: 1 upper case, 2 digit, 3 symbol, 4 exclamation mark, 5 other punctuation, 6 white space, 0 the rest.
_KIND = np.array([1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b"#*$%&|<>" else 4 if c == 33 else 6 if c in b" \t\n\r\x0b\x0c" else 5 if 33 < c < 127 and not chr(c).isalnum() else 0 for c in range(256)], np.uint8)


def statistics(text: str | None) -> list[float]:
    """The features of one text; an empty one has zeros throughout."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    n = len(words)
    if n == 0:
        return [0.0] * len(NAMES)
    kinds = sum(np.bincount(_KIND[np.frombuffer(raw, np.uint8)[at : at + (1 << 20)]], minlength=7) for at in range(0, len(raw), 1 << 20))
    solid = max(1, len(raw) - int(kinds[6]))
    counts = Counter(words)
    windows = max(1, n - 2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), solid / n, kinds[1] / solid, kinds[2] / solid, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        sum(c for w, c in counts.items() if w in _STOP) / n, len(counts) / n, max(counts.values()) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines), n / len(lines), raw.count(b".") / n,
    ]


@dataclass(frozen=True)
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return total


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 1.0) -> np.ndarray:
    """Steps for each bin by a tree of the given depth on sums of gradients and curvatures."""
    total_g, total_h = g.sum(), h.sum()
    leaf = np.full(len(g), total_g / (total_h + 1))
    if depth == 0 or len(g) < 2:
        return leaf
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
    gain[(ch < least) | (total_h - ch < least)] = -1
    at = int(np.argmax(gain))
    if gain[at] <= 1e-9:
        return leaf
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1, least), _tree(g[at + 1 :], h[at + 1 :], depth - 1, least)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps for each cell by the best cut of both axes, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = g.shape
    if a < 2 or b < 2:
        return np.zeros_like(g), 0.0
    q = [(c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1, -1] - c[-1:, :-1] - c[:-1, -1:] + c[:-1, :-1]) for c in (cg, ch)]
    gain = sum(x**2 / (y + 1) for x, y in zip(*q)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    value = [x[i, j] / (y[i, j] + 1) for x, y in zip(*q)]
    out[: i + 1, : j + 1], out[i + 1 :, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1) -> Model:
    """Fit on statistics and labels. Without rows of both classes the model gives the base rate."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    n = x.shape[1] if x.ndim == 2 else len(NAMES)
    x = x.reshape(-1, n)
    edges, coarse = ([_edges(x[:, f], bins) for f in range(n)] for bins in (BINS, PAIR_BINS))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) == 0 or y.min() == y.max():
        return Model(base, edges, tables, coarse, [], [])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bins = [np.searchsorted(edges[f], x[:, f], "right") for f in range(n)]
    wide = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(n)]
    margin, base = np.zeros(len(y)), 0.0

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for f in range(n):
            g, h = (np.bincount(bins[f], s, len(tables[f])) for s in slopes())
            step = rate * _tree(g, h)
            tables[f] += step
            margin += step[bins[f]]
    shape = [len(c) + 1 for c in coarse]
    cell = {(i, j): wide[i] * shape[j] + wide[j] for i, j in combinations(range(n), 2)}

    def sums(i: int, j: int) -> list[np.ndarray]:
        return [np.bincount(cell[i, j], s, shape[i] * shape[j]).reshape(shape[i], shape[j]) for s in slopes()]

    gains = {p: _quadrants(*sums(*p))[1] for p in cell}
    pairs = sorted(sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS])
    grids = [np.zeros((shape[i], shape[j])) for i, j in pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            step = rate * _quadrants(*sums(i, j))[0]
            grids[k] += step
            margin += step[wide[i], wide[j]]
    return Model(base, edges, tables, coarse, pairs, grids)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out part; only statistics reach the driver."""
    texts = sample_texts(docs, sample_ids(labels, "quality", per_class, *HELD_OUT))
    rows = sorted((r.y, *r.x) for r in texts.mapInArrow(_measured, "y int, x array<double>").collect())
    table = np.array(rows, np.float64).reshape(len(rows), len(NAMES) + 1)
    return fit(table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, held_out, score, predicted: one row per row.

    Null and empty texts have zeros as statistics and the score of these; very long texts are measured whole. Equal
    texts have equal scores, so rows that repeat have equal results; a null id is not held out. No rows give no rows;
    other columns, whatever their names, are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(2)], np.float64).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(model.margin(x), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, *HELD_OUT).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
