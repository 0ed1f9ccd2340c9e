"""Compression of vectors to a few codes each: k-means per part with Exponion search, in exact whole numbers.

A vector's components become floor(1024 * x) and are cut into ``parts`` equal consecutive parts. Each part position has a codebook of
``entries`` entries, which starts as the parts of the rows with the smallest ids. In each round every part is assigned to its nearest
entry and each entry becomes the floor of the mean of its parts; at last the parts are assigned once more.

**Exponion search.** A part starts at its previous entry a, at squared distance u. Whatever is as near as a lies within twice that distance
of a, so that its squared distance from a is 4u at most: the entries sorted by their distance from a are scanned up to there, and no
farther. The lowest index among the nearest of these is the answer, ties included, since all that tie lie in the radius. In the first
round every part starts at entry 0.

**Exact numbers.** Distances are sums of whole numbers. They are computed in float64 where every intermediate value stays below 2**53 in
that batch, and in Python's unbounded integers elsewhere. Sums of an entry travel as limbs of 32 bits where they exceed 62 bits.

**Tasks.** A round is one pass: tasks read the rows with their previous codes and write them with new ones, and one more row with the
task's own sums for each entry. Only these are added up, and only the codebooks, ``parts * entries`` entries, pass through the driver and
are broadcast; their size doesn't depend on the input. A lost task is done again from the table of the round before.

Defined results: rows whose vector is null, empty, or holds a null or non-finite component go, and so do those of another
dimension than most rows have (of equally frequent ones the largest); a dimension that ``parts`` doesn't divide is filled up with zeros;
rows that repeat an id are kept, each with its own code; among equal ids the smaller vector starts first, null ids start last; fewer rows
than ``entries`` make as many entries; an error that exceeds a long is null; an empty table gives no rows. Labels that are null are equal.
Other columns are left out, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows whose parts are compared at once.
_ROWS = 16_384
_LIMB = 32
_LONG = 2**63

Codebook = list[list[int]]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): float64 where every number is one that float64 tells exactly, else Python integers."""
    if not x.size or np.abs(x).max() < 2**40:
        return np.floor(x * 1024.0)
    exact = np.frompyfunc(lambda v: int(v) * 1024 if abs(v) >= 2**53 else int(np.floor(v * 1024.0)), 1, 1)
    return exact(x)


def _exactly(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 if no distance between them can reach 2**53, else as Python integers."""
    most = max((int(np.abs(a).max()) for a in (x, book) if a.size), default=0)
    kind = np.float64 if 8 * max(1, x.shape[1]) * most * most < 2**53 else object
    as_int = np.frompyfunc(int, 1, 1)
    return tuple(a.astype(np.float64) if kind is np.float64 else as_int(a) for a in (x, book))


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: all entries by their distance from it, and these squared distances."""
    square = (book * book).sum(1)
    apart = square[:, None] + square[None, :] - 2 * book.dot(book.T)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, 1)


def exponion(x: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row of whole numbers, from the entry it had before; ties go to the lower index."""
    x, book = _exactly(x, book)
    order, apart = neighbours(book)
    x_square, square = (x * x).sum(1), (book * book).sum(1)
    found, best = before.copy(), ((x - book[before]) * (x - book[before])).sum(1)
    by_entry = np.argsort(before, kind="stable")
    ends = np.searchsorted(before[by_entry], np.arange(len(book) + 1))
    for a in np.flatnonzero(np.diff(ends)):
        rows = by_entry[ends[a] : ends[a + 1]]
        reach = np.searchsorted(apart[a], 4 * best[rows], "right")
        rows = rows[np.argsort(-reach, kind="stable")]
        reach = -np.sort(-reach, kind="stable")
        low, width = 0, 16
        while low < reach[0]:
            near = np.sort(order[a, low : min(low + width, reach[0])])
            some = rows[: np.searchsorted(-reach, -low, "left")]
            d = x_square[some][:, None] + square[near] - 2 * x[some].dot(book[near].T)
            j = np.argmin(d, axis=1)
            d, j = d[np.arange(len(some)), j], near[j]
            better = (d < best[some]) | ((d == best[some]) & (j < found[some]))
            best[some[better]], found[some[better]] = d[better], j[better]
            low, width = low + width, 2 * width
    return found, best


def _limbs(value: int) -> list[int]:
    """The value as limbs of 32 bits, the last one signed; a value of at most 62 bits is its own only limb."""
    out = []
    while not -(1 << 62) <= value < 1 << 62:
        out.append(value & (1 << _LIMB) - 1)
        value >>= _LIMB
    return [*out, value]


def _matrix(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    """(rows, parts, width) whole numbers of a column of vectors, filled up with zeros."""
    x = whole(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim))
    width = -(-dim // parts)
    out = np.zeros((len(x), parts * width), x.dtype)
    out[:, :dim] = x
    return out.reshape(len(x), parts, width)


def _assigner(books: list[Codebook], dim: int, first: bool, with_sums: bool):
    """Rows with their codes and errors, and if wanted a last row with the task's sums: (part, entry, position, limb, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(books)
        made = [np.array(b, object).reshape(len(b), -1) for b in books]
        width = made[0].shape[1]
        sums = [np.zeros((len(b), width), object) for b in made]
        counts = np.zeros((parts, len(made[0])), np.int64)
        schema = None
        for batch in batches:
            for piece in (batch.slice(i, _ROWS) for i in range(0, len(batch), _ROWS)):
                n, schema = len(piece), piece.schema
                x = _matrix(piece.column("embedding"), dim, parts)
                old = np.zeros((n, parts), np.int64) if first else np.frombuffer(b"".join(piece.column("codes").to_pylist()), np.uint16).reshape(n, parts).astype(np.int64)
                codes, error = np.empty((n, parts), np.uint16), np.zeros(n, object)
                for p in range(parts):
                    found, apart = exponion(x[:, p], made[p], old[:, p])
                    codes[:, p] = found
                    error = error + np.frompyfunc(int, 1, 1)(apart)
                    if with_sums:
                        by = np.argsort(found, kind="stable")
                        entry, start = np.unique(found[by], return_index=True)
                        rows = x[by, p]
                        if rows.dtype != object:
                            rows = rows.astype(np.int64) if np.abs(rows).max(initial=0) < 2**45 else np.frompyfunc(int, 1, 1)(rows)
                        sums[p][entry] += np.add.reduceat(rows, start, axis=0).astype(object)
                        counts[p][entry] += np.diff([*start, n])
                errors = pa.array([int(e) if e < _LONG else None for e in error], pa.int64())
                yield _row_batch(piece, codes, errors)
        if with_sums and schema is not None:
            kept = [(p, e, i, k, v) for p in range(parts) for e in np.flatnonzero(counts[p]) for i in range(width) for k, v in enumerate(_limbs(int(sums[p][e, i])))]
            kept += [(p, e, -1, 0, int(counts[p][e])) for p in range(parts) for e in np.flatnonzero(counts[p])]
            yield _sum_batch(schema, kept)
        release()

    return run


_SUM = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])
_WRITTEN = "vec_id long, label {label}, embedding {vector}, codes binary, error long, sums array<struct<part:int,entry:int,at:int,limb:int,value:long>>"
_NAMES = ["vec_id", "label", "embedding", "codes", "error", "sums"]


def _row_batch(piece: pa.RecordBatch, codes: np.ndarray, errors: pa.Array) -> pa.RecordBatch:
    packed = pa.array([c.tobytes() for c in codes], pa.binary())
    return pa.RecordBatch.from_arrays([*(piece.column(c) for c in _NAMES[:3]), packed, errors, pa.nulls(len(piece), pa.list_(_SUM))], names=_NAMES)


def _sum_batch(schema: pa.Schema, kept: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([int(r[k]) for r in kept], t.type) for k, t in enumerate(_SUM)]
    sums = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SUM)))
    own = [pa.nulls(1, schema.field(c).type) for c in _NAMES[:3]]
    return pa.RecordBatch.from_arrays([*own, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), sums], names=_NAMES)


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, embedding) of the rows that are coded, and their dimension (0: there are none)."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x).where(x.isNotNull() & (F.size(x) > 0) & ~bad)
    most = rows.groupBy(F.size(x).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = most[0].dim if most else 0
    return rows.where(F.size(x) == dim), dim


def _new_books(written: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The floor of each entry's mean, from the sums of all tasks; an entry without parts stays."""
    one = written.where("sums IS NOT NULL").select(F.explode("sums").alias("s")).select("s.*")
    total = one.groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums: dict[tuple[int, int, int], int] = {}
    for r in total:
        key = (r.part, r.entry, r["at"])
        sums[key] = sums.get(key, 0) + (int(r.value) << _LIMB * r.limb)
    return [
        [[sums[p, e, i] // sums[p, e, -1] for i in range(len(old))] if (p, e, -1) in sums else old for e, old in enumerate(book)]
        for p, book in enumerate(books)
    ]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """(vec_id, label, embedding, codes, error) of the coded rows of ``vectors`` (vec_id, embedding, label), and the codebooks.

    ``codes`` are ``parts`` unsigned numbers of 16 bits.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    rows, dim = kept_vectors(vectors)
    kinds = dict(rows.dtypes)
    schema = _WRITTEN.format(label=kinds["label"], vector=kinds["embedding"])
    if not dim:
        return spark.createDataFrame([], schema).drop("sums"), []
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    cut = _matrix(pa.array([[float(v) for v in r.embedding] for r in first]), dim, parts)
    books = [[[int(v) for v in row] for row in cut[:, p]] for p in range(parts)]
    for turn in range(rounds + 1):
        last = turn == rounds
        written = scratch.save(rows.mapInArrow(_assigner(books, dim, turn == 0, not last), schema), f"round{turn}")
        if not last:
            books = _new_books(written, books)
        rows = written.where("codes IS NOT NULL").select("vec_id", "label", "embedding", "codes", "error")
        if turn:
            scratch.drop(f"round{turn - 1}")
    return rows, books


def books_digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors summed over equal labels, null if they exceed a long.

    Sums are formed in each task before they are shuffled, and met by a join on the label, whose hot values Spark's skew join splits.
    """
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    known = (F.count(F.lit(1)) == F.count("error")) & exact.between(-_LONG, _LONG - 1)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.when(known, exact).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
