"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words (A-Z in lower case, split at everything but letters, digits and
non-ASCII), its word pairs and its pairs with one word between. Every coordinate has its own learning rate, and the L1 term
leaves few weights that aren't zero; these are what is broadcast.

The model is fitted in one task on at most ``MOST_ROWS`` labelled rows outside the held-out fold; exact copies teach once.
Every text is scored whole.

Defined results: null and empty texts get the score of the intercept alone. Without labelled rows of both classes the score is
the smoothed share of label 1 (one half if there are none). Rows that repeat an id or a text are scored each by itself; which of
them teaches is told in ``labelled_sample``. Other columns pass through, whatever their names; a column named like the made one is
replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER_WORD, WordHashes, fit_in_one_task, labelled_sample, mix, with_made

MOST_ROWS = 16_000
DIMENSIONS = 1 << 21
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.1
EPOCHS = 8


def features(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashed words, pairs and skip-pairs; a feature comes as often as in the text."""
    h = known.of(text.encode().translate(LOWER_WORD).split() if text else [])
    if not len(h):
        return np.empty(0, np.int64)
    left = h * np.uint64(0x9E3779B97F4A7C15)
    pairs = mix(left[:-1] + h[1:])
    skips = mix((left[:-2] ^ np.uint64(0x5851F42D4C957F2D)) + h[2:])
    return (np.concatenate([h, pairs, skips]) >> np.uint64(43)).astype(np.int64)


def preparer():
    """text -> (digest of the text, its distinct features)"""
    known = WordHashes()
    return lambda text: (xxhash.xxh3_128_digest(text.encode()), np.unique(features(text, known)).astype(np.int32))


def fit(prepared: list[tuple[bytes, np.ndarray]], labels: np.ndarray) -> bytes:
    """Pickled (indexes, weights, intercept)."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not 0 < labels.sum() < len(labels):
        return pickle.dumps((np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share)))))
    once = {digest: (at, y) for (digest, at), y in zip(reversed(prepared), reversed(labels), strict=True)}
    rows = list(reversed(once.values()))
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, y = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            if abs(g) < 1e-3:
                continue
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = weights(np.arange(DIMENSIONS))
    at = np.flatnonzero(w)
    return pickle.dumps((at, w[at], bias))


def score_toxicity(docs: DataFrame, model: bytes, made: str = "toxicity") -> DataFrame:
    """``docs`` (text, ...) with the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most DIMENSIONS weights

    def maker():
        at, values, bias = pickle.loads(sent.value)
        w = np.zeros(DIMENSIONS, np.float32)
        w[at] = values
        known = WordHashes()

        def score(text: str | None) -> float:
            f = features(text, known)
            f = np.unique(f[w[f] != 0])
            return float(1 / (1 + np.exp(-np.clip(w[f].sum(dtype=np.float64) + bias, -35, 35))))

        return lambda texts: [pa.array([score(t) for t in texts], pa.float64())]

    return with_made(docs, "text", T.StructType([T.StructField(made, T.DoubleType())]), maker)


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> bytes:
    return fit_in_one_task(labelled_sample(docs, labels, "toxic", most), preparer, fit)
