"""Approximate nearest neighbours by largest inner product, found in a forest of sorted hash strings.

1. **Classes.** Rows with the same vector are one class, which keeps its ``k + 1`` smallest ids: a vector that a third of all rows
   have is indexed, searched and compared once.
2. **Spaces.** Classes of one dimension whose norms lie within a factor of two share a space. In it a vector is divided by the
   largest norm M and given one more component that makes its length 1, so that the largest inner product is the smallest angle.
3. **Trees.** Each tree gives a string of 64 signs of random projections. The strings of a tree are a sorted array, stored
   as a table; a position in it comes from counts of its partitions.
4. **Descent.** An asked vector stands at its place in each array. For each prefix length, the positions around it that share the
   prefix are a range, found in its block of the array with the two blocks beside it; it reaches ``BLOCK`` positions at most each way.
5. **Ascent.** All trees of a query go up together, a symbol at a time, until their ranges hold ``candidates`` positions.
6. **Scores.** Ranges meet the blocks' vectors, held in half precision, in matrix products; the best of each block go to the query, and
   the best ``SLACK`` more than ``k`` of these are scored exactly, in double precision, component by component in order.

``BLOCK`` and ``candidates`` bound work, and so recall, not who may be found: a class that is missed is missed because its strings share
no long prefix. README has the recall measured against brute force. No row meets more than three blocks of a tree, whatever the vectors.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component takes no part, nor does a row with a null
id; of rows that repeat an id the one with the smallest vector counts; vectors of different dimensions never meet; equal scores go
to the smaller id; with fewer other rows than ``k`` those that are found come back; an empty table gives none. Texts aren't read; other
columns are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TREES = 16
#: Positions that the ranges of a query hold together when its ascent ends.
CANDIDATES = 65_536
#: Positions of a block, and the farthest that a range reaches to either side.
BLOCK = 2048
#: Candidates beyond k that are scored exactly, for what half precision confuses.
SLACK = 12
BITS = 64
_SEED = 20_240_611
_ORDER = ("space", "tree", "h", "role", "rep")


@lru_cache(maxsize=4)
def _directions(dim: int, trees: int) -> np.ndarray:
    """(dim + 1, trees * BITS) random directions, the same in every task."""
    return np.random.default_rng((_SEED, dim)).standard_normal((dim + 1, trees * BITS))


def hash_strings(x: np.ndarray, last: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees) strings of signs as unsigned numbers, whose order is that of the strings."""
    signs = np.hstack([x, last[:, None]]) @ _directions(x.shape[1], trees) > 0
    return np.packbits(signs.reshape(len(x), trees, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def _signed(h: np.ndarray) -> np.ndarray:
    """Unsigned numbers as the long values of the same order, and back."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(h: np.ndarray) -> np.ndarray:
    return h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _numbers(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(name).to_numpy()


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one for each id."""
    x = F.col("embedding")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x).where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _classes(rows: DataFrame, asked: Column, k: int) -> DataFrame:
    """(rep, ids, embedding, asked, dim, norm): one row for each vector, its k + 1 smallest ids, whether one of its rows is asked.

    Rank and maximum are both reduced in the tasks that read the rows, before anything is shuffled.
    """
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    smallest = rows.select("embedding", "vec_id").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    ids = smallest.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    is_asked = rows.groupBy("embedding").agg(F.max(asked).alias("asked"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    largest = F.aggregate("embedding", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v.cast("double"))))
    scaled = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") / largest, F.lit(2.0)))
    usual = square.between(1e-200, 1e200)  # else the squares of its components can't be added
    norm = F.when(usual, F.sqrt(square)).otherwise(largest * F.sqrt(scaled))
    return ids.join(is_asked, "embedding").select(F.col("ids")[0].alias("rep"), "ids", "embedding", "asked", F.size("embedding").alias("dim"), norm.alias("norm"))


def _spaces(classes: DataFrame) -> dict[tuple[int, int], tuple[int, float]]:
    """(dimension, band of norms) -> (number, largest norm): as many as there are dimensions and powers of two among the norms."""
    found = classes.groupBy("dim", _band().alias("band")).agg(F.max("norm").alias("most")).collect()
    return {(r.dim, r.band): (i, r.most) for i, r in enumerate(sorted(found, key=lambda r: (r.dim, r.band)))}


def _band() -> Column:
    return F.round(F.log2("norm")).cast("int")


def _strings(classes: DataFrame, spaces: dict, trees: int) -> DataFrame:
    """(space, tree, h, role, rep): role 0 for a class in its space, role 1 for an asked one in each space of its dimension."""
    by_dim: dict[int, list] = {}
    for (dim, band), (number, most) in spaces.items():
        by_dim.setdefault(dim, []).append((band, number, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(trees, dtype=np.int32)

        def rows(space: int, role: int, h: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            n = len(rep)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n * trees, space, np.int32)), pa.array(np.tile(tree, n)), pa.array(_signed(h.ravel())), pa.array(np.full(n * trees, role, np.int32)), pa.array(np.repeat(rep, trees))],
                names=list(_ORDER),
            )

        for batch in batches:
            dims, bands, reps, asked, norms = (_numbers(batch, c) for c in ("dim", "band", "rep", "asked", "norm"))
            column = batch.column("embedding")
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                x = column.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                for band, number, most in by_dim[int(dim)]:
                    own = bands[here] == band
                    if own.any():
                        y = x[own] / most
                        last = np.sqrt(np.maximum(0, 1 - np.square(np.minimum(1, norms[here][own] / most))))
                        yield rows(number, 0, hash_strings(y, last, trees), reps[here][own])
                of = asked[here].astype(bool)
                if of.any():
                    h = hash_strings(x[of] / norms[here][of][:, None], np.zeros(of.sum()), trees)
                    for _, number, _ in by_dim[int(dim)]:
                        yield rows(number, 1, h, reps[here][of])

    source = classes.select("rep", "embedding", "asked", "dim", "norm", _band().alias("band"))
    return source.mapInArrow(run, "space int, tree int, h long, role int, rep long")


def _sorted_arrays(strings: DataFrame, scratch: Scratch) -> DataFrame:
    """``strings`` with pos, the position in the sorted array of its space and tree; the arrays are written in order.

    What the driver learns is how many rows of each array each partition holds: a few numbers a partition.
    """
    ordered = strings.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = scratch.save(ordered.select(*_ORDER, F.spark_partition_id().alias("part"), at.alias("at")), "arrays")
    before: dict[tuple[int, int], int] = {}
    starts = []
    for r in sorted(stored.groupBy("space", "tree", "part").agg(F.min("at").alias("least"), F.count("*").alias("n")).collect()):
        so_far = before.get((r.space, r.tree), 0)
        starts.append((r.space, r.tree, r.part, so_far - r.least))
        before[r.space, r.tree] = so_far + r.n
    shift = stored.sparkSession.createDataFrame(starts, "space int, tree int, part int, shift long")
    return stored.join(shift, ["space", "tree", "part"]).select(*_ORDER, (F.col("at") + F.col("shift")).alias("pos"))


def _block(pos: Column) -> Column:
    return F.floor(pos / BLOCK).cast("long")


def _reach(t: pa.Table) -> pa.Table:
    """For the queries of a block's own: how far to the left and to the right each prefix length is shared."""
    order = np.argsort(_numbers(t, "pos"), kind="stable")
    pos, h, block = _numbers(t, "pos")[order], _unsigned(_numbers(t, "h")[order]), _numbers(t, "block")[0]
    i = np.flatnonzero((_numbers(t, "role")[order] == 1) & (pos // BLOCK == block))
    reach = np.empty((len(i), BITS + 1, 2), np.int16)
    for length in range(BITS + 1):
        rest = np.uint64((1 << (BITS - length)) - 1)
        reach[:, length, 0] = np.minimum(BLOCK, i - np.searchsorted(h, h[i] & ~rest, "left"))
        reach[:, length, 1] = np.minimum(BLOCK, np.searchsorted(h, h[i] | rest, "right") - 1 - i)
    rep = _numbers(t, "rep")[order][i]
    n, head = len(i), {c: _numbers(t, c)[:1] for c in ("space", "tree")}
    return pa.table(
        {"rep": rep, "space": np.repeat(head["space"], n), "tree": np.repeat(head["tree"], n), "pos": pos[i], "reach": pa.array([x.tobytes() for x in reach], pa.binary())},
    )


def _ascend(candidates: int, trees: int):
    """Ranges (rep, space, tree, low, high) of the longest prefix whose ranges hold ``candidates`` positions in all trees together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = batch.column("found").flatten()
            tree, pos = (found.field(c).to_numpy().reshape(-1, trees) for c in ("tree", "pos"))
            reach = np.frombuffer(b"".join(found.field("reach").to_pylist()), np.int16).reshape(-1, trees, BITS + 1, 2).astype(np.int64)
            held = (reach.sum(3) + 1).sum(1)  # falls with the length of the prefix
            length = np.maximum(0, (held >= candidates).sum(1) - 1)
            chosen = np.take_along_axis(reach, length[:, None, None, None], 2)[:, :, 0]
            rep, space = (np.repeat(_numbers(batch, c), trees) for c in ("rep", "space"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (rep, space, tree.ravel(), (pos - chosen[:, :, 0]).ravel(), (pos + chosen[:, :, 1]).ravel())], names=["rep", "space", "tree", "low", "high"]
            )

    return run


def _meet(keep: int):
    """The ``keep`` best members of a block for each range that meets it, packed: (query, ids, scores)."""

    def run(t: pa.Table) -> pa.Table:
        low = _numbers(t, "low")
        asks = ~np.isnan(low.astype(np.float64))
        rep, code = _numbers(t, "rep"), t.column("code").combine_chunks()

        def matrix(which: np.ndarray) -> np.ndarray:
            return np.frombuffer(b"".join(code.take(pa.array(which)).to_pylist()), np.float16).astype(np.float32).reshape(len(which), -1)

        members, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: dict[str, list] = {"rep": [], "ids": [], "scores": []}
        if len(members) and len(queries):
            pos, of = _numbers(t, "pos")[members], matrix(members)
            most = _numbers(t, "most")[members[0]]
            for some in np.array_split(queries, -(-len(queries) // 512)):
                s = matrix(some) @ of.T * np.float32(1)
                s = np.where((pos >= low[some][:, None]) & (pos <= _numbers(t, "high")[some][:, None]), s, -np.inf)
                best = np.argpartition(-s, min(keep, s.shape[1]) - 1, axis=1)[:, :keep]
                for q, row, j in zip(some, s, best, strict=True):
                    j = j[row[j] > -np.inf]
                    if len(j):
                        out["rep"].append(rep[q])
                        out["ids"].append(rep[members[j]].astype(np.int64).tobytes())
                        out["scores"].append((row[j].astype(np.float64) * most).tobytes())
        return pa.table([pa.array(out["rep"], pa.int64()), pa.array(out["ids"], pa.binary()), pa.array(out["scores"], pa.binary())], names=["rep", "ids", "scores"])

    return run


def _merge(keep: int):
    """(query, found) pairs: of what all blocks found for a query, the ``keep`` best, and the query's own class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, found = [], []
            for rep, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("rep", "ids", "scores")), strict=True):
                i, s = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(scores), np.float64)
                i = i[np.lexsort((i, -s))]
                _, first = np.unique(i, return_index=True)
                best = i[np.sort(first)][:keep]
                best = best if rep in best else np.append(best, rep)
                query.append(np.full(len(best), rep))
                found.append(best)
            if query:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(found))], names=["query", "rep"])

    return run


def nearest(vectors: DataFrame, asked: Column, k: int = 20, trees: int = TREES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest that are found for each row of ``vectors`` (vec_id, embedding) where ``asked``.

    ``asked`` is a condition on vec_id. A query's own row is not among its neighbours.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "forest")
    rows = scratch.save(valid_vectors(vectors), "vectors")
    classes = scratch.save(_classes(rows, asked, k), "classes")
    spaces = _spaces(classes)
    if not spaces:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = spark.createDataFrame([(d, b, n, m) for (d, b), (n, m) in spaces.items()], "dim int, band int, space int, most double")

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = _numbers(b, "most")
            codes = [(np.array(x, np.float64) / m).astype(np.float16).tobytes() for x, m in zip(b.column("embedding").to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(codes, pa.binary()), b.column("most")], names=["rep", "code", "most"])

    placed = classes.withColumn("band", _band()).join(known, ["dim", "band"])
    codes = scratch.save(placed.select("rep", "embedding", "most").mapInArrow(half, "rep long, code binary, most double"), "codes")
    arrays = scratch.save(_sorted_arrays(_strings(classes, spaces, trees), scratch), "positions")

    around = arrays.withColumn("block", F.explode(F.sequence(F.greatest(_block(F.col("pos")) - 1, F.lit(0)), _block(F.col("pos")) + 1)))
    reach = around.groupBy("space", "tree", "block").applyInArrow(_reach, "rep long, space int, tree int, pos long, reach binary")
    together = reach.groupBy("rep", "space").agg(F.collect_list(F.struct("tree", "pos", "reach")).alias("found"))
    ranges = together.mapInArrow(_ascend(candidates, trees), "rep long, space int, tree int, low long, high long")

    visits = (
        ranges.withColumn("block", F.explode(F.sequence(_block(F.col("low")), _block(F.col("high"))))).join(codes.select("rep", "code"), "rep")
        .select("space", "tree", "block", "rep", "code", F.lit(None).cast("long").alias("pos"), "low", "high", F.lit(None).cast("double").alias("most"))
    )
    nothing = F.lit(None).cast("long")
    members = (
        arrays.where("role = 0").join(codes, "rep")
        .select("space", "tree", _block(F.col("pos")).alias("block"), "rep", "code", "pos", nothing.alias("low"), nothing.alias("high"), "most")
    )
    met = members.unionByName(visits).groupBy("space", "tree", "block").applyInArrow(_meet(k + SLACK), "rep long, ids binary, scores binary")
    gathered = met.groupBy("rep").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
    pairs = scratch.save(gathered.mapInArrow(_merge(k + 1 + SLACK), "query long, rep long"), "pairs")
    for name in ("arrays", "positions", "codes"):
        scratch.drop(name)

    # exact: component by component in order, in double precision
    of_query = classes.select(F.col("rep").alias("query"), F.col("embedding").alias("of"))
    product = F.aggregate(F.zip_with("of", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    scored = pairs.join(classes.select("rep", "ids", "embedding"), "rep").join(of_query, "query").select("query", "ids", product.alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    listed = scored.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("nth", best).where(F.col("nth") <= k + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    lists = lists.join(of_query, "query").select(F.col("of").alias("embedding"), "found")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = rows.where(asked).select(F.col("vec_id").alias("query_id"), "embedding").join(lists, "embedding").select("query_id", F.posexplode(others).alias("at", "one"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
