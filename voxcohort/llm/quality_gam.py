"""Quality classifier: a generalised additive model with pairwise interactions.

Shape features of a text (lengths, shares of symbols, capitals and repeats) are cut
into quantile bins. Shallow trees, fitted to the log-loss gradient of one feature at a
time in turn, add up to one lookup table per feature; the pairs that explain most of
what is left get small two-way tables in the same manner. A score is the sum of table
entries by bin, for whole batches at once.

The model is fitted in numpy on a bounded sample (``limit`` labelled rows, of which
only the features reach the driver); every document is scored, whole. Cases: null or
empty text has all features 0 and gets a score like others; with fewer than two
classes the score is the smoothed share of label 1; repeated rows, null ids and other
columns are carried; no labels or ids enter a score.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.labelled import fold, training_rows

FOLDS, HELD = 3, 1
LIMIT = 20_000       # labelled rows used for fitting
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 200, 60, 0.1
FEATURES = ["words", "word_bytes", "symbols", "pipes", "exclaims", "capitals", "digits", "points", "spaces", "line_bytes",
            "distinct", "repeats", "line_repeats", "longest", "above_ascii"]
_CAPITALS, _LETTERS, _DIGITS = (bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), bytes(range(48, 58)))


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    n, of = len(raw), lambda chars: len(raw) - len(raw.translate(None, chars))
    words, lines = raw.split(), raw.split(b"\n")
    w, letters = max(len(words), 1), max(of(_LETTERS), 1)
    return [np.log1p(len(words)), sum(map(len, words)) / w, of(b"#$%&*^~<>={}[]\\") / n, of(b"|") / n, of(b"!?") / n, of(_CAPITALS) / letters,
            of(_DIGITS) / n, of(b".,;:") / n, of(b" \t\n\r\x0b\x0c") / n, np.log1p(n / len(lines)), len(set(words)) / w,
            sum(map(operator.eq, words, words[1:])) / w, 1 - len(set(lines)) / len(lines), np.log1p(max(map(len, words), default=0)),
            1 - len(raw.translate(None, bytes(range(128, 256)))) / n]


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edge, x[:, f], side="right")]
        coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.pair_edges)]
        for (a, b), values in zip(self.pairs, self.pair_tables):
            total += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of the shallow tree that best follows gradient sums ``g``."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(gs[-1], hs[-1]))
    gains = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1])
    at = int(np.argmax(gains)) + 1
    return np.r_[_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)]


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best cut of a two-way table into four parts: values and gain."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    parts = []
    for s in (gs, hs):
        a, top, left, all_ = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        parts.append((a, top - a, left - a, all_ - top - left + a))
    gains = sum(_gain(x, y) for x, y in zip(*parts))
    i, j = np.unravel_index(np.argmax(gains), gains.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)),
                                   (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), *parts):
        out[rows, cols] = _leaf(x[i, j], y[i, j])
    return out, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of one-feature tables, then of the best pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Gam(base, [], [], [], [], [])
    edges = [_edges(c, BINS) for c in x.T]
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]
    tables, total = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, values in zip(bins, tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(values)), np.bincount(b, h, len(values)))
            values += step
            total += step[b]
    pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(pair_edges, x.T)]
    shape = [len(e) + 1 for e in pair_edges]

    def sums(a, b):
        g, h = slopes()
        cell = coarse[a] * shape[b] + coarse[b]
        return [np.bincount(cell, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in (g, h)]

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(*sums(*p))[1])[:PAIRS]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for (a, b), values in zip(ranked, pair_tables):
            step = RATE * _quadrants(*sums(a, b))[0]
            values += step
            total += step[coarse[a], coarse[b]]
    return Gam(base, edges, tables, ranked, pair_edges, pair_tables)


def trained(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Gam:
    @F.pandas_udf("array<double>")
    def values(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    rows = training_rows(docs, labels, "quality", FOLDS, HELD, limit).select(values("text").alias("x"), "y").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    order = np.lexsort((rows["y"], *x.T))      # the same fit whatever order the rows came in
    return fit(x[order], rows["y"].to_numpy(float)[order])


def score_of(model: Gam) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))))
    return score(F.col("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = trained(docs, labels, limit)
    return docs.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), score_of(model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` scored 0.5 or more."""
    return docs.withColumn("__score", score_of(trained(docs, labels, limit))).where("__score >= 0.5").drop("__score")
