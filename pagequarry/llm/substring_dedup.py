"""Exact removal of passages that repeat across documents.

Every window of ``k`` consecutive words gets a Rabin-Karp hash. A map task works through its documents in blocks of a few
million windows. Inside a block all but the smallest document of a hash are already known to repeat, so a block sends one
entry per distinct hash (hash, document, position), packed by bucket, and one for each other text of that document; a hash that a third of all documents hold costs one
entry per block and not one per document. A bucket counts its hashes and finds the smallest document of each; the windows of
larger documents are marked. The marks return to the documents in groups that follow the texts' bytes, and there the marked windows
merge into maximal removal intervals. Every bucket and every group is a partition of its own.

Two windows count as equal if their 64-bit hashes and their buckets (from a second, independent hash) agree. As the number of
buckets follows the input, the odds that a window is taken for another one are about 1e-13, whatever the size of the input: of
the 1.6e13 windows of 100 TB, one or two would be.

What a block decides and what it sends belong together, so a task that is repeated must see its documents in the same order. It
does where documents are read from files; an input that is anything but a scan of files is written to the shared folder first.

Defined results: a null, empty or short text (fewer than ``k`` words) has no windows and stays as it is. A null id is smaller
than none and nothing is removed from it. Rows that repeat an id are one document (equal ids are not smaller), each row being
cut by itself. A window that repeats only inside one document stays. Other columns pass through, whatever their names; columns
named like the made ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, WordHashes, batch_of, bound_batches, is_scan, mix, nested, release, rows_of, window_hashes, words

#: Windows of one block of a map task; bounds its memory.
BLOCK_WINDOWS = 2_000_000
#: Bytes of text for one bucket, about two million windows.
BUCKET_BYTES = 12_000_000
#: Bytes of text whose documents' marks come together in one group.
GROUP_BYTES = 48_000_000
#: Rows of bucket >= 0 are entries of that bucket; those of bucket -1 - g are marks for the documents of group g.
_ENTRY = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
_MARK = pa.schema([("grp", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary())])
_DOC = pa.schema([("doc", pa.int64()), ("text_key", pa.int64()), ("starts", pa.binary())])
MADE = ["n_words", "n_removed", "removed", "clean_text"]


def _pack(keys: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes]:
    """Places in order of document and position: the documents with their numbers of places, and steps between positions.

    ``row`` are indexes into ``keys`` (pairs of id and text key). Steps lie in byte planes and are compressed.
    """
    turn = np.flatnonzero(np.diff(row, prepend=-1))
    head = np.column_stack([keys[row[turn]], np.diff(np.append(turn, len(row)))])
    steps = np.diff(start, prepend=0)
    steps[turn] = start[turn]
    return zstandard.compress(head.tobytes(), 1), zstandard.compress(steps.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(docs: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents with their numbers of places, positions)"""
    head = np.frombuffer(zstandard.decompress(docs), np.int64).reshape(-1, 3)
    planes = np.frombuffer(zstandard.decompress(starts), np.uint8).reshape(4, -1)
    total = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.int64)
    turn = np.cumsum(head[:, 2]) - head[:, 2]
    before = np.where(turn > 0, total[turn - 1], 0)
    return head, total - np.repeat(before, head[:, 2])


def _all(packed: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row, start) of several packed lists."""
    parts = [_unpack(*p) for p in packed]
    head = np.concatenate([p[0] for p in parts])
    return head[:, :2], np.repeat(np.arange(len(head)), head[:, 2]), np.concatenate([p[1] for p in parts])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _by_group(keys: np.ndarray, row: np.ndarray, start: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Marks, packed by group of documents; they come in order of document and position."""
    group = (mix(keys[:, 0].astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)[row]
    order = np.argsort(group, kind="stable")
    for part in np.split(order, _runs(group[order])[1:]) if len(order) else ():
        yield int(group[part[0]]), *_pack(keys, row[part], start[part])


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield batch_of(dict(zip(schema.names, zip(*rows[i : i + size], strict=True), strict=True)), schema)


def _block(docs: list[tuple], buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """The payloads of one block for the buckets, and the marks that the block alone decides."""
    docs = sorted(docs, key=lambda d: d[:2])
    keys = np.array([d[:2] for d in docs], np.int64)
    sizes = [len(d[2]) for d in docs]
    row = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    start = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    h = np.concatenate([d[2] for d in docs])
    bucket = ((np.concatenate([d[3] for d in docs]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(h, kind="stable")  # equal hashes stay in order of their documents
    first = _runs(h[order])
    smallest = np.repeat(keys[row[order[first]], 0], np.diff(np.append(first, len(h))))
    marked = np.empty(len(h), bool)
    marked[order] = keys[row[order], 0] > smallest
    at = np.flatnonzero(marked)
    out = [(-1 - g, None, d, s) for g, d, s in _by_group(keys, row[at], start[at], groups)]
    text_key = keys[row[order], 1]
    new = np.ones(len(h), bool)
    new[1:] = text_key[1:] != text_key[:-1]
    new[first] = True
    leads = np.zeros(len(h), bool)
    leads[order] = new & ~marked[order]  # the smallest document's first place in each of its texts
    entries = np.flatnonzero(leads)
    by = entries[np.argsort(bucket[entries].astype(np.uint16) if buckets < 65536 else bucket[entries], kind="stable")]
    for part in np.split(by, _runs(bucket[by])[1:]):
        out.append((int(bucket[part[0]]), h[part].tobytes(), *_pack(keys, row[part], start[part])))
    yield from _batches(out, _ENTRY)


def _emit(k: int, buckets: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        docs, n = [], 0
        for batch in batches:
            for doc, text_key, text in rows_of(batch):
                if doc is None:
                    continue
                h = known.of(words(text))
                if len(h) >= k:
                    docs.append((doc, text_key, window_hashes(h, k), window_hashes(h, k, 1)))
                    n += len(h) - k + 1
                    if n >= BLOCK_WINDOWS:
                        yield from _block(docs, buckets, groups)
                        docs, n = [], 0
        if docs:
            yield from _block(docs, buckets, groups)
        docs = []
        release()

    return run


def _bucket_marks(payloads: list[tuple], groups: int) -> list[tuple]:
    """What a bucket marks: every entry but those of the smallest document of its hash."""
    if len(payloads) < 2:  # one block has decided by itself
        return []
    keys, row, start = _all([p[2:] for p in payloads])
    h = np.concatenate([np.frombuffer(p[1], np.uint64) for p in payloads])
    order = np.argsort(h)
    first = _runs(h[order])
    doc = keys[row[order], 0]
    smallest = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(h))))
    marked = np.empty(len(h), bool)
    marked[order] = doc > smallest
    at = np.flatnonzero(marked)
    return list(_by_group(keys, row[at], start[at], groups))


def _count(groups: int):
    """Buckets arrive whole and in order; marks that blocks have decided pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            passed = []
            for row in rows_of(batch):
                if row[0] < 0:
                    passed.append((-1 - row[0], *row[2:]))
                    continue
                if row[0] != now:
                    yield from _batches(_bucket_marks(held, groups), _MARK)
                    now, held = row[0], []
                held.append(row)
            yield from _batches(passed, _MARK)
        yield from _batches(_bucket_marks(held, groups), _MARK)
        held = []
        release()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive whole and in order; one row for each document with marks leaves."""

    def of_group(held: list[tuple]) -> list[tuple]:
        if not held:
            return []
        keys, row, start = _all(held)
        order = np.lexsort((start, keys[row, 1], keys[row, 0]))
        row, start = row[order], start[order]
        cut = np.flatnonzero((keys[row[1:]] != keys[row[:-1]]).any(1)) + 1
        return [(int(keys[r[0], 0]), int(keys[r[0], 1]), zstandard.compress(s.astype(np.uint32).tobytes(), 1)) for r, s in zip(np.split(row, cut), np.split(start, cut), strict=True)]

    now, held = None, []
    for batch in batches:
        for group, *packed in rows_of(batch):
            if group != now:
                yield from _batches(of_group(held), _DOC, 2048)
                now, held = group, []
            held.append(tuple(packed))
    yield from _batches(of_group(held), _DOC, 2048)


def removal_marks(docs: DataFrame, k: int) -> DataFrame:
    """(doc, text_key, starts): compressed start positions of the windows to remove, one row for each document that has any."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, partitions, total // BUCKET_BYTES)
    groups = max(partitions, total // GROUP_BYTES)
    entries = docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(_emit(k, buckets, groups), "bucket long, hashes binary, docs binary, starts binary")
    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(buckets)))  # marks pass through anywhere
    marks = entries.repartitionById(buckets, place.cast("int")).sortWithinPartitions("bucket").mapInArrow(_count(groups), "grp long, docs binary, starts binary")
    return marks.repartitionById(groups, F.col("grp").cast("int")).sortWithinPartitions("grp").mapInArrow(_gather, "doc long, text_key long, starts binary")


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def _cut(text: str | None, marks: bytes | None, k: int, known: WordHashes) -> tuple:
    """(number of words, number removed, intervals of words, what is left of the text)."""
    tokens = words(text)
    if not marks or not tokens:
        return len(tokens), 0, [], text
    starts = np.frombuffer(zstandard.decompress(marks), np.uint32)
    same = window_hashes(known.of(tokens), k)
    starts = np.flatnonzero(np.isin(same, same[starts]))  # an entry stands for all places of its window in the document
    covered = np.zeros(len(tokens) + 1, np.int32)
    covered[starts] += 1
    covered[starts + k] -= 1
    gone = np.cumsum(covered[:-1]) > 0
    intervals = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
    data = text.encode()
    inside = ~_BLANK[np.frombuffer(data, np.uint8)]
    begins = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8)])) == 1)
    left, at = [], 0
    for a, b in intervals.tolist():
        left.append(data[at : begins[a]])
        at = int(begins[b]) if b < len(tokens) else len(data)
    left.append(data[at:])
    return len(tokens), int(gone.sum()), intervals.tolist(), b"".join(left).decode()


def substring_dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_removed, removed (word intervals, end exclusive) and clean_text.

    clean_text is the text without the removed intervals; what separates the kept words stays.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own, kept = nested(docs, [*MADE, "text"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), own.alias("own"))
    if not is_scan(rows):
        rows = Scratch(spark, "substring-dedup").save(rows, "documents")
    marks = removal_marks(rows, k).select("doc", "text_key", "starts")
    rows = rows.withColumn("key", F.xxhash64("text"))
    rows = rows.join(marks, (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("text_key")), "left").select("text", "starts", "own")
    names = ["own", "text", *MADE]
    kinds = ("text string", "n_words long", "n_removed long", "removed array<array<long>>", "clean_text string")
    out = T.StructType([T.StructField("own", rows.schema["own"].dataType), *T.StructType.fromDDL(", ".join(kinds)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            cut = [_cut(t, m, k, known) for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            new = [pa.array([c[i] for c in cut], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), *new], names=names)

    left = [c for c in docs.columns if c.lower() not in MADE]
    return rows.mapInArrow(run, out).select(*(F.col("text").alias(c) if c.lower() == "text" else F.col("own").getField(c).alias(c) for c in left), *MADE)
