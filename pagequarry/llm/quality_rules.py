"""Quality rules: counted base rules, and a logistic regression over hashed word and character n-grams.

The regression sees the shares of a text's words, word pairs, character 3-grams and character 4-grams (code points of the text in
lower-case A-Z).
It is fitted by Adagrad on most of a bounded sample of labelled rows; Platt scaling on the remaining rows makes its margins
probabilities. Texts are scored in Arrow batches against the fixed thresholds of ``Thresholds``.

Defined results: null and empty texts have zero counts and fail the base rules; their probability is that of the intercept.
Without labelled rows of both classes the probability is the smoothed share of label 1. Rows that repeat an id or a text are
scored each by itself; which of them teaches is told in ``labelled_sample``. Other columns pass through, whatever their names;
columns named like the made ones are replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, WordHashes, fit_in_one_task, labelled_sample, mix, window_hashes, with_made

MOST_ROWS = 8_000
BITS = 17
GROUPS = 4
SCALE = 20.0
EPOCHS, STEP = 8, 0.5
_SYMBOLS = b"#*$%&|<>"
_MANY = np.uint32(0x01000193)
#: The six separators and the bytes that continue a code point.
_NOT_COUNTED = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])

MADE = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("quality", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
])


@dataclass(frozen=True)
class Thresholds:
    least_words: int = 50
    most_repeat_percent: int = 50
    least_quality: float = 0.5


def counts(text: str | None, known: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    tokens = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if len(tokens) >= 3:
        _, at, n = np.unique(window_hashes(known.of(tokens), 3), return_inverse=True, return_counts=True)
        covered = np.zeros(len(tokens), bool)
        twice = n[at] > 1
        for i in range(3):
            covered[i : len(tokens) - 2 + i] |= twice
        repeated = int(covered.sum())
    return len(tokens), len(data.translate(None, _NOT_COUNTED)), len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def grams(text: str | None, known: WordHashes) -> list[np.ndarray]:
    """Hashed features of the four groups, each in its own range."""
    data = text.encode().translate(LOWER) if text else b""
    h = known.of(data.split())
    shift = np.uint64(64 - BITS)
    c = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)  # code points
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    low = (c[:-2] * _MANY + c[1:-1]) * _MANY + c[2:] if len(c) > 2 else c[:0]
    wide = low[:-1] * _MANY + c[3:] if len(c) > 3 else c[:0]
    out = [(h >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)]
    out += [((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) for x in (low, wide)]
    return [x + (g << BITS) for g, x in enumerate(out)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make margins probabilities, by damped Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * len(y) * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def preparer():
    """text -> (features, their values)"""
    known = WordHashes()

    def prepare(text: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.unique(g, return_counts=True) for g in grams(text, known)]
        return np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([SCALE * p[1] / max(1, p[1].sum()) for p in parts]).astype(np.float32)

    return prepare


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> bytes:
    """Pickled (weights, intercept), with the calibration in both."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels):
        return pickle.dumps((np.zeros(GROUPS << BITS, np.float32), prior))
    order = np.random.default_rng(11).permutation(len(rows))
    apart = order[: len(rows) // 5]
    train = order[len(rows) // 5 :]
    w, seen, bias = np.zeros(GROUPS << BITS), np.full(GROUPS << BITS, 1e-4), prior

    def margins(which):
        return np.array([np.dot(w[rows[i][0]], rows[i][1]) for i in which]) + bias

    rng = np.random.default_rng(13)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), 128):
            part = train[at : at + 128]
            error = _sigmoid(margins(part)) - labels[part]
            index = np.concatenate([rows[i][0] for i in part])
            g = np.bincount(index, np.concatenate([e * rows[i][1] for e, i in zip(error, part, strict=True)]), GROUPS << BITS) / len(part)
            seen += g * g
            w -= STEP * g / np.sqrt(seen)
            bias -= 0.05 * error.mean()
    a, b = _platt(margins(apart), labels[apart]) if len(set(labels[apart])) > 1 else (1.0, 0.0)
    return pickle.dumps(((a * w).astype(np.float32), float(a * bias + b)))


def apply_quality_rules(docs: DataFrame, model: bytes, limits: Thresholds = Thresholds()) -> DataFrame:
    """``docs`` (text, ...) with the counts, base_failed, quality (probability of label 1) and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())

    def maker():
        w, bias = pickle.loads(sent.value)
        known = WordHashes()

        def row(text: str | None) -> tuple:
            n = counts(text, known)
            failed = n[0] < limits.least_words or 100 * n[4] > limits.most_repeat_percent * n[0]
            quality = float(_sigmoid(bias + SCALE * sum(float(w[g].mean(dtype=np.float64)) for g in grams(text, known) if len(g))))
            return *n, failed, quality, not failed and quality >= limits.least_quality

        def make(texts: list) -> list[pa.Array]:
            rows = [row(t) for t in texts]
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return make

    return with_made(docs, "text", MADE, maker)


def train_quality_rules(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> bytes:
    return fit_in_one_task(labelled_sample(docs, labels, "quality", most), preparer, fit)
