"""Models as batch functions over columns: embedding and scoring, loaded once per worker and called on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def embed(df: DataFrame, load: Callable[[], Embedder], text: str = "text", made: str = "vector") -> DataFrame:
    """A vector for each text. ``load`` runs once for each batch iterator of a worker, not for each row."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.fillna("").tolist()))

    return df.withColumn(made, run(F.col(text)))


def pair_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` from a model of text pairs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return lambda a, b: run(a, b)


def hashed_embedder(dimensions: int = 64) -> Embedder:
    """A stand-in without weights: signed counts of hashed words, of unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return run
