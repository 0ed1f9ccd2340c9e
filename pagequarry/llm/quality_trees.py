"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are cut into at most 64 bins at quantiles of the sample; trees grow level by level from sums of gradients in those
bins. All trees are complete to the same depth and lie in flat arrays, so that a batch of rows goes down all of them with a
few vectorised steps.

The model is fitted in one task on at most ``MOST_ROWS`` labelled rows outside the held-out fold. Every text is scored whole.

Defined results: null and empty texts have statistics of zero and get the score of these. Without labelled rows of both classes
the score is the smoothed share of label 1. Rows that repeat an id or a text are scored each by itself; which of them teaches is
told in ``labelled_sample``. Other columns pass through, whatever their names; a column named like the made one is replaced.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WordHashes, fit_in_one_task, labelled_sample, window_hashes, with_made

MOST_ROWS = 16_000
TREES, DEPTH, BINS = 80, 4, 64
RATE, L2, LEAST_WEIGHT = 0.15, 1.0, 5.0

_CLASS = np.full(256, 0, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence marks, 6 non-ASCII lead, 7 continuation, 8 symbols
for _chars, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:!?", 5), (range(0xC0, 256), 6), (range(0x80, 0xC0), 7), (b"#*$%&|<>", 8)):
    _CLASS[list(_chars)] = _kind
_URL = re.compile(rb"https?://|www\.")


def statistics(text: str | None, known: WordHashes) -> list[float]:
    data = text.encode() if text else b""
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9).astype(float)
    chars = max(1.0, len(data) - kinds[7])
    tokens = data.split()
    n = len(tokens)
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.array([len(t) for t in tokens]) if n else np.zeros(1)
    h = known.of(tokens)
    one, two, three = (np.unique(window_hashes(h, k), return_counts=True)[1] if n >= k else np.zeros(1) for k in (1, 2, 3))
    rate = lambda counts, total: float(len(counts)) / max(1, total)
    return [
        np.log1p(chars), np.log1p(n), np.log1p(len(lines)),
        *(kinds[[1, 2, 3, 4, 5, 6, 8, 0]] / chars),
        lengths.mean(), lengths.std(), float(lengths.max()), n / max(1, len(lines)),
        rate(one, n), rate(two, n - 1), rate(three, n - 2), float(one.max()) / max(1, n), float(two.max()) / max(1, n - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(t[-1] in b".,;:!?" for t in tokens) / max(1, n), sum(t[-2:] == b"!!" for t in tokens) / max(1, n),
        sum(t[-1] in b"#*$%&|<>" for t in tokens) / max(1, n), sum(t.isupper() for t in tokens) / max(1, n),
        sum(len(t) == 1 for t in tokens) / max(1, n), len(_URL.findall(data)) / max(1, n),
    ]


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict:
    """Flat arrays: feature and threshold of inner nodes (breadth first), values of leaves, one row a tree."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = {"start": start, "feature": np.zeros((0, inner), np.int32), "threshold": np.zeros((0, inner)), "value": np.zeros((0, leaves))}
    if not 0 < y.sum() < len(y):
        return model
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin b: at most cuts[b]
    flat = binned + np.arange(d) * BINS
    margin = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        for depth in range(DEPTH):
            width = 2**depth
            at = (node[:, None] * (d * BINS) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, d), width * d * BINS).reshape(width, d, BINS).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            right = np.zeros(len(y), bool)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[width - 1 + k], threshold[width - 1 + k] = j, cuts[j][b]
                    here = node == k
                    right[here] = binned[here, j] > b
            node = 2 * node + right
        g_leaf, h_leaf = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value = -RATE * g_leaf / (h_leaf + L2)
        margin += value[node]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return model | {"feature": np.stack(features), "threshold": np.stack(thresholds), "value": np.stack(values)}


def predict_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: every row goes down all trees at once."""
    trees = len(model["value"])
    node = np.zeros((len(x), trees), np.int64)
    tree, row = np.arange(trees), np.arange(len(x))[:, None]
    for depth in range(DEPTH if trees else 0):
        at = 2**depth - 1 + node
        node = 2 * node + (x[row, model["feature"][tree, at]] > model["threshold"][tree, at])
    return 1 / (1 + np.exp(-(model["start"] + model["value"][tree, node].sum(1))))


def preparer():
    known = WordHashes()
    return lambda text: statistics(text, known)


def fit(rows: list[list[float]], labels: np.ndarray) -> bytes:
    return pickle.dumps(fit_trees(np.array(rows, np.float64).reshape(len(rows), len(statistics("", WordHashes()))), labels))


def score_quality(docs: DataFrame, model: bytes, made: str = "quality") -> DataFrame:
    """``docs`` (text, ...) with the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def maker():
        trees, known = pickle.loads(sent.value), WordHashes()
        return lambda texts: [pa.array(predict_trees(trees, np.array([statistics(t, known) for t in texts], np.float64)), pa.float64())]

    return with_made(docs, "text", T.StructType([T.StructField(made, T.DoubleType())]), maker)


def train_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> bytes:
    return fit_in_one_task(labelled_sample(docs, labels, "quality", most), preparer, fit)
