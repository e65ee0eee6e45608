"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically: each round gives every feature in turn a tree of at most LEAVES leaves on that
feature's bins, fitted to the current logistic residuals, and adds its small step to the feature's lookup table. Then
the pairs of features whose residuals a four-cell cut explains best get tables of their own in the same way. A score is
a sum of table entries at a row's bins, so whole batches are scored with vector additions.

The fit reads at most ``sample`` labelled rows, least hash of doc_id first; scoring reads all rows.

Defined cases: a null text counts as empty (all features zero); without labelled rows of both classes the score is the
share of good labels (one half without any).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
BINS, PAIR_BINS, LEAVES = 32, 8, 4
ROUNDS, PAIR_ROUNDS, STEP, PAIRS = 120, 40, 0.12, 8
FEATURES = ["log_words", "word_length", "distinct", "repeated_next", "symbols", "capitals", "digits", "stops", "same_lines", "line_words", "not_ascii", "bars", "shouts", "top_word", "lines", "short_words"]

_CLASS = np.zeros((6, 256))
_CLASS[0, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [ord(c) for c in ".,;:?"]] = 1
_CLASS[4, 128:] = 1
_CLASS[5, 97:123] = 1


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, upper, digits, stops, high, lower = (_CLASS @ byte).tolist()
    size, counts, lines = len(raw), Counter(words), raw.split(b"\n")
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        symbols / size,
        upper / max(1.0, upper + lower),
        digits / size,
        stops / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        high / size,
        float(byte[124]) / n,
        float(byte[33]) / n,
        max(counts.values()) / n,
        float(np.log1p(len(lines))),
        sum(len(w) < 4 for w in words) / n,
    ]


def tree_step(gain: np.ndarray, weight: np.ndarray, leaves: int, least: float = 1.0) -> np.ndarray:
    """Values of a shallow regression tree on ordered bins: Newton steps of the leaves, best cuts first."""
    g, w = np.r_[0, np.cumsum(gain)], np.r_[0, np.cumsum(weight)]
    cuts = [0, len(gain)]
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, wl, gr, wr = g[m] - g[a], w[m] - w[a], g[b] - g[m], w[b] - w[m]
            rise = gl**2 / (wl + least) + gr**2 / (wr + least) - (g[b] - g[a]) ** 2 / (w[b] - w[a] + least)
            if rise.max() > best:
                best, where = float(rise.max()), int(m[rise.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    value = (g[cuts[1:]] - g[cuts[:-1]]) / (w[cuts[1:]] - w[cuts[:-1]] + least)
    return np.repeat(value, np.diff(cuts))


@dataclass
class Gam:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Gam(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [bin_edges(c, BINS) for c in x.T]
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            r, w = residual()
            step = STEP * tree_step(np.bincount(at[k], r, len(table)), np.bincount(at[k], w, len(table)), LEAVES)
            table += step
            total += step[at[k]]
    model.pair_edges = [bin_edges(c, PAIR_BINS) for c in x.T]
    cell = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def cut(a: int, b: int, r: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and values of the best cut of a pair's grid into four cells."""
        grid = lambda v: np.bincount(cell[a] * shape[b] + cell[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])
        g, h = grid(r), grid(w)
        gs, hs = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        best: tuple[float, np.ndarray] = (0.0, np.zeros((shape[a], shape[b])))
        for i in range(1, shape[a]):
            for j in range(1, shape[b]):
                four = lambda s: np.array([[s[i, j], s[i, -1] - s[i, j]], [s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]]])  # noqa: E731, B023
                gg, hh = four(gs), four(hs) + 1.0
                rise = float((gg**2 / hh).sum())
                if rise > best[0]:
                    best = rise, np.repeat(np.repeat(gg / hh, [i, shape[a] - i], 0), [j, shape[b] - j], 1)
        return best

    r, w = residual()
    gains = sorted(((cut(a, b, r, w)[0], (a, b)) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)[:PAIRS]
    model.pairs = [p for _, p in gains]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            _, value = cut(a, b, *residual())
            table += STEP * value
            total += STEP * value[cell[a], cell[b]]
    return model


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, use: Column, sample: int) -> DataFrame:
    """doc_id, text, label of at most ``sample`` labelled rows with ``use``, least hash first. The broadcast side has at most that many rows of two numbers."""
    rows = labels.where(F.col(target).isNotNull() & use).groupBy("doc_id").agg(F.max(target).cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column, target: str = "quality", sample: int = SAMPLE) -> Gam:
    common.configure(docs.sparkSession)
    own = labelled_sample(docs, labels, target, use, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("label"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    # repeated rows of an id may be many: the bound holds for what reaches the driver as well
    rows = own.mapInArrow(run, "doc_id long, label double, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in rows]))


def score_quality(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, text and score of every row of ``docs``, of which only doc_id and text are read."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            x = np.array([features(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Gam, threshold: float) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches the threshold; the score is computed beside the row, without a join."""

    @F.pandas_udf("double")
    def score(text):  # noqa: ANN001, ANN202
        return __import__("pandas").Series(model.score(np.array([features(t) for t in text]).reshape(-1, len(FEATURES))))

    common.configure(docs.sparkSession)
    return docs.where(score(F.col("text")) >= threshold)
