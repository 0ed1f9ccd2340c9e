"""What the training-data operators share: scratch tables, batch bounds, words, hashes and labelled samples."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.sources.shared import shared_path

#: Rows of one Arrow batch. Texts may be long, so that a batch of the default 10,000 rows could exceed a worker's memory.
BATCH_ROWS = 200
#: Bytes of the texts that a model is fitted to.
MOST_SAMPLE_BYTES = 512_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to ``rows`` rows for plans that carry whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives up its shuffles as soon as it stands, and not when the driver next collects garbage.

    A write is planned anew each time, so nothing else reads these shuffles; until it ends, lost ones are made again as ever.
    """
    before = spark.conf.get(_REMOVE, "false")
    spark.conf.set(_REMOVE, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE, before)


_OPEN: dict[str, list[Scratch]] = {}


class Scratch:
    """Parquet tables of one operator's run under the shared folder. A result may read them, so they stay until ``clean_up``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, shared_path(spark, name)
        _OPEN.setdefault(spark.sparkContext.applicationId, []).append(self)

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write ``df``, partitioned ``by`` columns, and return the written table; its lineage ends there."""
        path = f"{self.base}/{name}"
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that operators of this application have written; call it when their results are stored."""
    for scratch in _OPEN.pop(spark.sparkContext.applicationId, []):
        scratch.drop()


_SCANS = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LogicalRDD"}


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads files row by row, so that a task that is repeated sees its rows in the same order."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in _SCANS and node.children().length() == 1:
        node = node.children().apply(0)
    return node.children().length() == 0 and node.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation")


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


# --- columns ---------------------------------------------------------------------------------------------------------


def named(column: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the next name like it that no column of ``df`` has in any case."""
    taken, name, n = {c.lower() for c in df.columns}, wanted, 0
    while name.lower() in taken:
        name, n = f"{wanted}_{n}", n + 1
    return name


def nested(df: DataFrame, left_out: Iterable[str] = ()) -> tuple[Column, list[str]]:
    """All columns but ``left_out`` as one struct, under whose roof no name can clash, and their names."""
    out = {c.lower() for c in left_out}
    kept = [c for c in df.columns if c.lower() not in out]
    return F.struct(*map(named, kept)) if kept else F.struct(F.lit(None).cast("int").alias("nothing")), kept


def unnested(kept: list[str], own: str = "own") -> list[Column]:
    """The columns of ``nested`` again."""
    return [F.col(own).getField(c).alias(c) for c in kept]


# --- words -----------------------------------------------------------------------------------------------------------

#: Lower-cases A-Z and nothing else, in UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte but letters and digits becomes a space.
LOWER_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: bytes.split() splits at just these six bytes."""
    if not text:
        return []
    data = text.encode()
    return (data.translate(LOWER) if lower else data).split()


class WordHashes(dict):
    """Word -> 64-bit hash. It forgets what it knows when it is full, so that its memory stays bounded."""

    def __init__(self, seed: int = 0, most: int = 250_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


# --- hashes ----------------------------------------------------------------------------------------------------------

_BASES = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on one another."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2**64 and their inverses, at least n of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        base = _BASES[which]
        full = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for x in full:
            x[0] = 1
        have = _POWERS[which] = tuple(np.cumprod(x, dtype=np.uint64) for x in full)
    return have


def window_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes (polynomial modulo 2**64 over word hashes) of all windows of k words, rolled by prefix sums."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(which, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def sequence_hash(h: np.ndarray) -> int:
    """Of a whole sequence that is shorter than a window; its length counts, so that it equals no window's."""
    return int(window_hashes(h, len(h))[0]) ^ (len(h) * 0x632BE59BD9B4E019 & (1 << 64) - 1)


# --- batches ---------------------------------------------------------------------------------------------------------


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns.values(), schema.types, strict=True)], schema=schema)


def with_made(docs: DataFrame, source: str, made: T.StructType, maker: Callable[[], Callable[[list], list[pa.Array]]], at_once: int = BATCH_ROWS) -> DataFrame:
    """``docs`` with the columns ``made``, which a function of a list of ``source`` values gives; ``maker`` makes it in each task.

    All columns pass through, whatever their names; columns named like the made ones are replaced.
    """
    bound_batches(docs.sparkSession)
    own, _ = nested(docs, [*made.names, source])
    rows = docs.select(named(source).alias("source"), own.alias("own"))
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            for part in (batch.slice(i, at_once) for i in range(0, len(batch), at_once)):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(0).to_pylist())], names=out.names)

    left = [c for c in docs.columns if c.lower() not in {n.lower() for n in made.names}]
    old = (F.col("source") if c.lower() == source.lower() else F.col("own").getField(c) for c in left)
    return rows.mapInArrow(run, out).select(*(x.alias(c) for x, c in zip(old, left, strict=True)), *made.names)


# --- labelled samples ------------------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, parts: int = 5, most_bytes: int = MOST_SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside fold 0, taken by a hash of the id.

    ``most`` bounds what is broadcast, and ``most_bytes`` the texts that one task later reads: rows come in order of the hash
    until their texts exceed it. Rows without id or label, and ids with contradicting labels, teach nothing. Of rows that repeat
    an id, the one with the smallest text teaches, so that a sample doesn't depend on the order of the rows.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", parts) != 0))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where(F.col("label") == F.col("_most"))
        .select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most)
    )
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        .withColumn("text", F.coalesce("text", F.lit(""))).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    )
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id")  # over ``most`` rows
    return sample.withColumn("so_far", F.sum(F.octet_length("text").cast("long")).over(in_order)).where(F.col("so_far") <= most_bytes).drop("so_far")


def release() -> None:
    """Give freed memory back to the system: a worker stays for later tasks, and what it holds counts against its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fit_in_one_task(sample: DataFrame, preparer: Callable[[], Callable[[str], Any]], fit: Callable[[list, np.ndarray], bytes]) -> bytes:
    """Fit a model to a bounded sample in one task, which Spark repeats if its executor is lost; returns the pickled model.

    ``preparer()`` gives a function that makes a text's features as it arrives, so that texts aren't held. Rows are put in a
    fixed order first, so that the model doesn't depend on how they arrive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare = preparer()
        rows = [(xxhash.xxh3_64_intdigest(str(i).encode()), i, prepare(t), y) for b in batches for i, t, y in rows_of(b)]
        rows.sort(key=lambda r: r[:2])
        prepare = None
        model = fit([r[2] for r in rows], np.array([r[3] for r in rows], np.float64))
        rows = []
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    models = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(models[0][0]) if models else fit([], np.empty(0))  # an empty sample has no task
