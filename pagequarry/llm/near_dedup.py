"""Near-duplicate groups by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives for each document the number of its distinct word shingles, a 128-bit digest of the set and
   the keys of its bands. A single hash per shingle fills ``BANDS * ROWS`` bins; an empty bin takes the value of the first
   filled bin in its own fixed random order of the bins (optimal densification).
2. Documents with equal digests are one class, represented by its smallest id, so that thousands of copies cost nothing more.
3. Representatives that share a band's bucket are linked with one of them only, the bucket's hub, taken by a hash that differs
   from band to band. The number of candidates is thus at most the number of bucket entries.
4. Candidates are confirmed on the full shingle sets of both texts. Links found so far give components.
5. Buckets whose members still lie in different components may hide a link that no hub showed. There, every member outside the
   bucket's largest component is compared with the members of the other components, in blocks of bounded size inside a task:
   first by signatures, with ``MARGIN`` below the threshold, then by the sets' 32-bit hashes where a set has at most
   ``WHOLE_SETS`` shingles. Only pairs that pass leave the task, each from the first bucket that it shares, to be confirmed
   like the others.

With 44 bands of 6 rows, a pair at similarity 0.8 shares no bucket with a chance of 2e-6, and less above it. A link that only
step 5 can show is missed with a chance of 3e-5 (four standard deviations of the estimate).

Defined results: a text without words (null, empty, blank) has an empty set and is linked with nothing. A text with fewer words
than a shingle has one shingle, the whole sequence. Rows that repeat an id are one node, linked through any of their texts.
A row with a null id is linked with nothing, has a null component and is kept. Ties go to the smaller id. ``near_duplicate_classes``
reads doc_id and text alone; ``keep_one`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, bound_batches, fresh, mix, named, release, rows_of, sequence_hash, window_hashes, words
from .components import components

BANDS, ROWS = 44, 6
BINS = BANDS * ROWS
#: Of an estimated similarity; the estimate's standard deviation at 0.8 is 0.0246.
MARGIN = 0.1
#: Members of a bucket that are compared with as many others in one piece.
BLOCK = 2048
#: Shingles up to which a set goes along as a whole; of larger sets the signature alone decides before the confirmation.
WHOLE_SETS = 2048


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    h = known.of(words(text, lower=True))
    if len(h) >= size:
        return np.unique(window_hashes(h, size))
    return np.array([sequence_hash(h)], np.uint64) if len(h) else h


@cache
def _orders() -> np.ndarray:
    """For each bin, the rank of every other bin in that bin's random order."""
    return np.random.default_rng(20_240_601).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)


def signature(shingle_hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash. As the hashes ascend, so do their bins, and the first of a bin is its minimum."""
    bins = ((shingle_hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[filled] = shingle_hashes[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        out[empty] = out[filled[_orders()[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = np.concatenate([sig.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)[:, None]], axis=1)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            counts, digests, bands = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size, known)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

    return run


def _confirm(size: int, percent: int):
    """Keeps the pairs whose sets meet the threshold. The set of a hub is kept while its pairs pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hub, hub_set = WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            a_out, b_out = [], []
            for a, b, a_text, b_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hub != b_text:
                    hub, hub_set = b_text, shingles(b_text, size, known)
                own = shingles(a_text, size, known)
                both = np.intersect1d(own, hub_set, assume_unique=True).size
                if both and 100 * both >= percent * (own.size + hub_set.size - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _sketch(size: int):
    """A text's band keys, its signature in a byte a bin, and its whole set in 32-bit hashes if that isn't too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            counts, bands, prints, sets = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size, known)
                sig = signature(s) if len(s) else None
                counts.append(len(s))
                bands.append(band_keys(sig).tobytes() if len(s) else None)
                prints.append((mix(sig) & np.uint64(255)).astype(np.uint8).tobytes() if len(s) else None)
                sets.append(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() if 0 < len(s) <= WHOLE_SETS else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(bands, pa.binary()), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "bands", "print", "whole"])

    return run


def _across(percent: int):
    """Pairs of members of different components that may meet the threshold, from whole (bucket, block, block) groups in order."""
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in rows_of(batch):
                if row[:3] != now:
                    yield from pairs(held)
                    now, held = row[:3], []
                held.append(row)
        yield from pairs(held)
        held = []
        release()

    def may_link(a: bytes | None, b: bytes | None, a_size: int, b_size: int) -> bool:
        if a is None or b is None:
            return True
        both = np.intersect1d(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), assume_unique=True).size + 2  # equal hashes in a set cost at most so many
        return 100 * both >= percent * (a_size + b_size - both)

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        bucket, one, two = rows[0][:3]
        block, rep, n, component, largest = (np.array([r[i] for r in rows], np.int64) for i in range(3, 8))
        bands = np.frombuffer(b"".join(r[8] for r in rows), np.int64).reshape(-1, BANDS)
        prints = np.frombuffer(b"".join(r[9] for r in rows), np.uint8).reshape(-1, BINS)
        whole = np.array([r[10] is not None for r in rows])
        for x in np.flatnonzero(component != largest):
            fits = (component != component[x]) & ((component == largest) | (component > component[x])) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            if one != two:
                fits &= block != block[x]
            at = np.flatnonzero(fits)
            at = at[whole[at] & whole[x] | ((prints[at] == prints[x]).mean(1) >= least)]  # whole sets need no estimate
            at = at[bands[x][(bands[at] == bands[x]).argmax(1)] == bucket]  # the first bucket that both are in
            at = [i for i in at.tolist() if may_link(rows[x][10], rows[i][10], n[x], n[i])]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[at], rep[x])), pa.array(np.minimum(rep[at], rep[x]))], names=["a", "b"])

    return run


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    component_id is the smallest id reachable over links of at least ``percent`` % similarity; kept marks its own row.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = scratch.save(source.mapInArrow(_describe(shingle), "doc_id long, n_shingles long, digest binary, bands array<long>"), "described")
    linkable = described.where("digest is not null and doc_id is not null")
    several = described.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_distinct("digest").alias("texts")).where("rows > 1").select("doc_id", "texts")
    repeats = not several.isEmpty()

    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    placed = linkable.join(classes, "digest")
    reps = placed.where("doc_id = rep").dropDuplicates(["digest"])
    entries = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    hubs = (
        entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("bucket", "rep").alias("rank"), "rep", "n")).alias("hub"))
        .where("members > 1").drop("members")
    )
    shared = scratch.save(entries.join(hubs, "bucket"), "shared")  # a bucket of one member links nothing

    def fit(x: str, y: str):
        """Sizes whose sets can meet the threshold at all."""
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    # the texts that any later step can ask for; the join is a shuffle at every size, as the ids' number follows the input
    wanted = shared.select(F.col("rep").alias("id")).distinct().hint("merge")
    texts = source.join(wanted, source["doc_id"] == wanted["id"], "left_semi")
    texts = scratch.save(texts.distinct() if repeats else texts, "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The links among candidate pairs (a, b), by the full sets of both texts."""
        mine = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
        theirs = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
        both = pairs.join(mine, "a").join(theirs, "b").select("a", "b", "a_text", "b_text")
        return scratch.save(both.mapInArrow(_confirm(shingle, percent), "a long, b long").distinct(), f"{name}-links")

    stars = shared.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), "n", F.col("hub.n").alias("m"))
    pairs = scratch.save(stars.where((F.col("a") != F.col("b")) & fit("n", "m")).select("a", "b").distinct(), "stars")
    links = confirmed(pairs, "star")
    if repeats:  # an id with several texts joins what these are linked with
        twice = placed.join(several.where("texts > 1"), "doc_id", "left_semi").where("doc_id <> rep")
        links = scratch.save(links.union(twice.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "links")
    found = components(links, scratch, "star-components")

    member = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    split = (
        member.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        .groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("size", "component")).alias("largest"), F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
        .where("parts > 1").drop("parts")
    )
    opened = scratch.save(member.join(split, "bucket"), "open")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # read from files, so that a bucket's members are spread out before they are dealt to pairs of blocks
    dealt = opened.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = opened.select(F.col("rep").alias("id")).distinct()
    marks = texts.join(asked, texts["doc_id"] == asked["id"], "left_semi").mapInArrow(_sketch(shingle), "rep long, n long, bands binary, print binary, whole binary")
    dealt = dealt.join(marks, ["rep", "n"]).select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "n", "component", "largest", "bands", "print", "whole")
    dealt = dealt.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    across = dealt.mapInArrow(_across(percent), "a long, b long").where("a <> b").distinct()
    tested = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    untested = across.join(tested, ["a", "b"], "left_anti")
    untested = scratch.save(untested, "across")
    if not untested.isEmpty():
        more = confirmed(untested, "across")
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")), scratch, "components")

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    linked = linkable.join(of_class, "digest").select("doc_id", "n_shingles", "component_id")
    alone = described.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if repeats:  # a row without words stands with the other rows of its id
        known = linked.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("other"))
        alone = alone.join(known, alone["doc_id"] == known["id"], "left").select("doc_id", "n_shingles", F.coalesce("other", "component_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of every near-duplicate group of ``docs``, the one with the smallest id; all columns stay as they are."""
    gone_id = fresh(docs, "gone")
    gone = near_duplicate_classes(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == named(gone_id), "left_anti")
    repeated = docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.isEmpty():
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
