"""Toxicity: a factorization machine over hashed terms.

A text's distinct terms (lower-case runs between punctuation and space) are hashed.
The terms whose presence goes along with the label in the sample, by a chi-squared
statistic, enter the model: linear weights, and a factor vector each, whose inner
products are the weights of pairs, so an insult next to a second one or to a group
counts for more than the two alone.

The model is fitted in numpy on a bounded sample (``limit`` labelled rows, of which
only term hashes reach the driver); every document is scored, whole. Cases: null or
empty text has no terms and gets the score of the base weight; with fewer than two
classes all scores are the smoothed share of label 1; repeated rows and null ids are
scored one by one; other columns are ignored; no labels or ids enter a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.labelled import fold, training_rows

FOLDS, HELD = 5, 0
LIMIT = 20_000       # labelled rows used for fitting
BUCKETS = 1 << 24
TERMS = 512          # terms in the model
FACTORS = 6
LEAST = 5            # sample documents that a term of the model is in
EPOCHS, RATE, PENALTY = 300, 0.05, 2e-4
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_hashes(text: str | None) -> set[int]:
    """Buckets of the distinct terms of a whole text."""
    return {zlib.crc32(w) % BUCKETS for w in set((text or "").encode().translate(_PLAIN).split())}


@dataclass
class FactorizationMachine:
    base: float
    terms: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.weights)), np.float32)
        for n, t in enumerate(texts):
            for h in term_hashes(t) & self.terms.keys():
                x[n, self.terms[h]] = 1
        return _probability(_raw(x, self.base, self.weights, self.factors))


def _raw(x, base, weights, factors):
    both = x @ factors
    return base + x @ weights + 0.5 * ((both * both).sum(1) - x @ (factors * factors).sum(1))


def _probability(z):
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    none = FactorizationMachine(base, {}, np.zeros(0), np.zeros((0, FACTORS)))
    if len(set(y.tolist())) < 2:
        return none
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, at = np.unique(flat, return_inverse=True)
    seen, hits = np.bincount(at), np.bincount(at, y[owner])
    mean = y.mean()
    strength = np.where(seen >= LEAST, (hits - seen * mean) ** 2 / (seen * mean * (1 - mean)), 0)
    chosen = np.lexsort((names, -strength))[:TERMS]
    chosen = chosen[strength[chosen] > 0]
    if not len(chosen):
        return none
    column = np.full(len(names), -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    here = column[at] >= 0
    x[owner[here], column[at][here]] = 1
    rng = np.random.default_rng(7)
    p = [np.array([base]), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS))]
    m, s = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    for epoch in range(1, EPOCHS + 1):
        both = x @ p[2]
        g = (_probability(_raw(x, p[0][0], p[1], p[2])) - y) / len(y)
        grads = [np.array([g.sum()]), x.T @ g + PENALTY * p[1],
                 x.T @ (g[:, None] * both) - p[2] * (x.T @ g)[:, None] + PENALTY * p[2]]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d * d
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** epoch)) / (np.sqrt(s[k] / (1 - 0.999 ** epoch)) + 1e-8)
    return FactorizationMachine(float(p[0][0]), {int(names[c]): k for k, c in enumerate(chosen)}, p[1], p[2])


def trained(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> FactorizationMachine:
    @F.pandas_udf("array<int>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(term_hashes(t)))

    rows = training_rows(docs, labels, "toxic", FOLDS, HELD, limit).select(hashes("text").alias("x"), "y").toPandas()
    rows = [(np.asarray(x, np.int64), y) for x, y in zip(rows["x"], rows["y"])]
    rows.sort(key=lambda r: (r[1], len(r[0]), r[0].tobytes()))      # the same fit whatever order the rows came in
    return fit([r[0] for r in rows], np.array([r[1] for r in rows], float))


def score_of(model: FactorizationMachine) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))
    return score(F.col("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = trained(docs, labels, limit)
    return docs.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), score_of(model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
