"""A stored BM25 index by term: only what a query asks for is read, and blocks that can't reach its best k aren't scored.

**Layout**, all Parquet under one path, in segments that are written once each (a segment that is written again replaces itself):

* ``postings``, partitioned by a bucket of the term and sorted by term: a row for each term and block of about ``BLOCK`` documents, with the
  documents, their counts of the term and lengths, the largest count and the smallest length;
* ``terms`` (term, df), partitioned alike; ``docs`` (doc_id, dl); ``stats`` (n_docs, sum_dl).

Statistics are summed over segments, so an index that grew by segments ranks like one that was built at once; ``merge`` makes one segment
of all, with full blocks.

**Search.** The queries' terms select buckets, then rows by term. A first pass scores, for each query, the few blocks where its rarest terms
weigh most; the k-th best gain there is a floor. The second goes through the blocks: a block's largest counts and smallest lengths bound
what any of its documents can gain, and only queries whose floor that reaches are scored in it. The result is exact: rows are those
of ``retrieval.bm25_top_k``, ties included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators import retrieval as r
from pagequarry.sources.shared import remove, shared_path, small_batches

#: Documents of a block (a power of two), and buckets of terms.
BLOCK, BUCKETS = 256, 32
#: Rarest terms of a query, and blocks, that its first pass looks at. They decide how much is skipped, not what is found.
RAREST, FIRST_BLOCKS = 4, 4
#: Up to so many terms are filters of the scan; more are a join.
MOST_FILTERED = 5_000
_SLACK = 1e-8


@dataclass(frozen=True)
class PostingsIndex:
    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/kind/{name}").schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    @property
    def docs(self) -> DataFrame:
        """doc_id, dl"""
        return self._read("docs").select("doc_id", "dl")

    @property
    def terms(self) -> DataFrame:
        """term, df: over all segments"""
        return self._read("terms").groupBy("term").agg(F.sum("df").alias("df"))

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs, avgdl"""
        return self._read("stats").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.try_divide(F.sum("sum_dl"), F.sum("n_docs")).alias("avgdl"))

    @property
    def postings(self) -> DataFrame:
        """segment, bucket, term, block, docs, tfs, dls, max_tf, min_dl"""
        return self._read("postings")

    @property
    def segments(self) -> list[int]:
        return sorted(x.segment for x in self._read("stats").select("segment").distinct().collect())

    def add(self, docs: DataFrame, segment: int, doc_id: str = "doc_id", text: str = "text") -> None:
        """Write documents, whose ids are new, as a segment, in place of what it held."""
        _write_segment(r.counted_terms(docs, doc_id, text), self.path, segment)

    def top_k(self, queries: DataFrame, k: int = 15, k1: float = 1.5, b: float = 0.75, delta: float = 1.0) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, text), as ``retrieval.bm25_top_k``."""
        schema = T.StructType([queries.schema["query_id"], T.StructField("doc_id", self.docs.schema["doc_id"].dataType), T.StructField("gain", T.DoubleType())])

        def one(some: DataFrame) -> tuple[DataFrame, list]:
            search = _Search(self, some, k, k1, b)
            return search.gains(), search.sent

        return r.rank_gains(self, queries, r.in_passes(r.text_queries(queries), one, schema), k, delta)

    def skipped(self, queries: DataFrame, k: int = 15, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, n_postings, n_scored): postings of a query's terms, and those of the blocks that its second pass scores."""
        return _Search(self, r.text_queries(queries).drop("bytes"), k, k1, b).counted()


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> PostingsIndex:
    """A new index of documents (doc_id, text) with one segment."""
    index = create(docs.sparkSession, path, docs.schema[doc_id].dataType.simpleString())
    index.add(docs, 0, doc_id, text)
    return index


def create(spark: SparkSession, path: str, id_type: str = "string") -> PostingsIndex:
    """An index without segments, in place of what stood there."""
    kinds = {
        "docs": (f"doc_id {id_type}, dl int, segment int", ["segment"]), "stats": ("n_docs long, sum_dl long, segment int", ["segment"]), "terms": ("term string, df long, segment int, bucket int", ["segment", "bucket"]),
        "postings": (f"term string, block long, docs array<{id_type}>, tfs array<int>, dls array<int>, max_tf int, min_dl int, segment int, bucket int", ["segment", "bucket"]),
    }
    for name, (schema, keys) in kinds.items():
        none = spark.createDataFrame([], schema)
        none.coalesce(1).write.mode("overwrite").parquet(f"{path}/kind/{name}")
        none.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/{name}")
    return PostingsIndex(spark, path)


def merge(index: PostingsIndex, path: str) -> PostingsIndex:
    """A new index at ``path`` with all segments' documents in one."""
    made = create(index.spark, path, index.docs.schema["doc_id"].dataType.simpleString())
    one = index.postings.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("z")).select(F.col("z.docs").alias("doc_id"), F.struct("term", F.col("z.tfs").cast("long").alias("tf")).alias("t"))
    terms = one.groupBy("doc_id").agg(F.collect_list("t").alias("terms"))
    none = F.array().cast(terms.schema["terms"].dataType)
    _write_segment(index.docs.join(terms, "doc_id", "left").select("doc_id", "dl", F.coalesce("terms", none).alias("terms")), path, 0)
    return made


def _write_segment(forward: DataFrame, path: str, segment: int) -> None:
    """The tables of documents (doc_id, dl, terms: array of (term, tf))."""
    spark = forward.sparkSession
    at, staged = f"segment={segment}", shared_path(spark, "postings")
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)  # as the rows are written, so that each keeps its own
    with small_batches(spark):
        forward.withColumn("block", block).write.option("compression", "zstd").parquet(staged)
    held = spark.read.parquet(staged)
    kind = dict(forward.dtypes)["doc_id"]
    rows = held.select("block", "doc_id", "dl", "terms").mapInArrow(_by_term, f"term string, block long, docs array<{kind}>, tfs array<int>, dls array<int>, max_tf int, min_dl int")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    rows = rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    with small_batches(spark):
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/{at}")
    df = spark.read.schema(rows.schema).parquet(f"{path}/postings/{at}").groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("df"))
    df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/{at}")
    held.select("doc_id", "dl").write.mode("overwrite").parquet(f"{path}/docs/{at}")
    held.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("sum_dl")).write.mode("overwrite").parquet(f"{path}/stats/{at}")
    remove(spark, staged)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut where a block ends: the last block of a batch waits for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        block = batch.column(0).to_numpy()
        ends = np.flatnonzero(block[1:] != block[:-1]) + 1
        if rest and rest[-1].column(0)[-1].as_py() != block[0]:
            yield pa.concat_batches(rest)
            rest = []
        if len(ends):
            yield pa.concat_batches([*rest, batch.slice(0, ends[-1])])
            rest = []
        rest.append(batch.slice(ends[-1]) if len(ends) else batch)
    if rest:
        yield pa.concat_batches(rest)


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their terms to rows of a term and a block. A block that two tasks read has a row from each."""
    for batch in _whole_blocks(batches):
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        sizes, flat = np.diff(offsets), lists.flatten()
        if not len(flat):
            continue
        row = np.repeat(np.arange(len(batch)), sizes)
        coded = flat.field(0).dictionary_encode()
        blocks, block = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        key = coded.indices.to_numpy().astype(np.int64) * len(blocks) + block[row]
        order = np.argsort(key, kind="stable")
        kinds, start = np.unique(key[order], return_index=True)
        tf, dl = flat.field(1).to_numpy()[order].astype(np.int32), batch.column(2).to_numpy()[row][order].astype(np.int32)
        ends = pa.array(np.append(start, len(order)), pa.int32())
        made = [
            coded.dictionary.take(pa.array(kinds // len(blocks))), pa.array(blocks[kinds % len(blocks)]), pa.ListArray.from_arrays(ends, batch.column(1).take(pa.array(row[order]))),
            pa.ListArray.from_arrays(ends, pa.array(tf)), pa.ListArray.from_arrays(ends, pa.array(dl)), pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(dl, start)),
        ]
        yield pa.RecordBatch.from_arrays(made, names=["term", "block", "docs", "tfs", "dls", "max_tf", "min_dl"])


class _Search:
    """One pass of queries, whose weights fit on the driver."""

    def __init__(self, index: PostingsIndex, queries: DataFrame, k: int, k1: float, b: float):
        self.index, self.k, self.sent = index, k, []
        self.kind = T.StructType([queries.schema["query_id"], T.StructField("doc_id", index.docs.schema["doc_id"].dataType), T.StructField("gain", T.DoubleType())])
        average = float(index.stats.first()["avgdl"] or 0.0) or 1.0
        self.share = lambda tf, dl: tf * (k1 + 1) / (k1 * (1 - b + b * dl / average) + tf)
        wanted = r.query_terms(queries).select("term").distinct()
        some = [x.term for x in wanted.limit(MOST_FILTERED + 1).collect()]
        self.only: Callable[[DataFrame], DataFrame] = lambda t: t.join(wanted, "term", "left_semi")
        if len(some) <= MOST_FILTERED:
            buckets = [x.b for x in self.index.spark.createDataFrame([(x,) for x in some], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
            self.only = lambda t: t.where(F.col("bucket").isin(buckets) & F.col("term").isin(some))
        df = self.only(index._read("terms")).groupBy("term").agg(F.sum("df").alias("df"))
        self.weights = r.weigh(queries, df, index.stats)
        held = self.weights.select("query_id", "term", "w").toArrow()
        ids, terms = (held.column(c).combine_chunks().dictionary_encode() for c in (0, 1))
        term_of = terms.indices.to_numpy()
        order = np.argsort(term_of, kind="stable")  # the queries of a term side by side
        starts = np.searchsorted(term_of[order], np.arange(len(terms.dictionary) + 1))
        self.ids, self.queries = ids.dictionary, (terms.dictionary.to_pylist(), starts, ids.indices.to_numpy()[order], held.column(2).to_numpy()[order])

    def _first_blocks(self) -> DataFrame:
        """(segment, block, asks): for each query the blocks where its rarest terms may weigh most."""
        rare = self.weights.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "term"))).where(F.col("n") <= RAREST)
        most = self.only(self.index.postings).select("segment", "block", "term", self.share(F.col("max_tf"), F.col("min_dl")).alias("share"))
        top = most.join(rare, "term").groupBy("query_id", "segment", "block").agg(F.sum(F.col("share") * F.col("w")).alias("bound"))
        best = top.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))).where(F.col("n") <= FIRST_BLOCKS)
        return best.groupBy("segment", "block").agg(F.collect_list("query_id").alias("asks"))

    def _blocks(self, run: Callable[[pa.Table], pa.Table], schema, given: DataFrame | None = None) -> DataFrame:
        """``run`` on the asked postings of each block; with ``given`` on its blocks alone, which have one more row, with ``asks``."""
        rows = self.only(self.index.postings).select("segment", "block", "term", "docs", "tfs", "dls", "max_tf", "min_dl")
        if given is not None:
            rows = rows.join(given.select("segment", "block"), ["segment", "block"], "left_semi").unionByName(given, allowMissingColumns=True)
        return rows.groupBy("segment", "block").applyInArrow(run, schema)

    def _floors(self) -> np.ndarray:
        """For each query a gain that k documents reach; minus infinity where the first blocks hold fewer."""
        sent, share, k, names = self._send(), self.share, self.k, self.kind.names

        def run(t: pa.Table) -> pa.Table:
            ids, queries, _ = sent.value
            asks = pc.index_in(t.column("asks").combine_chunks().drop_null().flatten(), ids).to_numpy(zero_copy_only=False)
            return _scored(t.filter(pc.is_valid(t.column("term"))), ids, queries, np.sort(asks.astype(np.int64)), share, k, names)

        found = self._blocks(run, self.kind, self._first_blocks())
        worst = r.top_k(found, self.k, score="gain").groupBy("query_id").agg(F.min("gain").alias("gain"), F.count("*").alias("n")).where(F.col("n") >= self.k).collect()
        at = {q: i for i, q in enumerate(self.ids.to_pylist())}
        floors = np.full(len(at), -np.inf)
        for row in worst:
            floors[at[row.query_id]] = row.gain - _SLACK
        return floors

    def _send(self, floors: np.ndarray | None = None):
        self.sent.append(self.index.spark.sparkContext.broadcast((self.ids, self.queries, floors)))
        return self.sent[-1]

    def gains(self) -> DataFrame:
        """(query_id, doc_id, gain): for each block the best k of the queries that it may concern."""
        sent, share, k, names = self._send(self._floors() if len(self.ids) else None), self.share, self.k, self.kind.names

        def run(t: pa.Table) -> pa.Table:
            ids, queries, floors = sent.value
            return _scored(t, ids, queries, _concerned(t, queries, floors, share), share, k, names)

        return self._blocks(run, self.kind)

    def counted(self) -> DataFrame:
        sent, share = self._send(self._floors() if len(self.ids) else None), self.share
        schema = T.StructType([self.kind["query_id"], T.StructField("n_postings", T.LongType()), T.StructField("n_scored", T.LongType())])

        def run(t: pa.Table) -> pa.Table:
            ids, queries, floors = sent.value
            vocabulary, starts, query_of, _ = queries
            term = pc.index_in(t.column("term"), pa.array(vocabulary, pa.string())).to_numpy()
            held = pc.list_value_length(t.column("docs")).to_numpy()
            each = np.zeros(len(ids), np.int64)
            for i, n in zip(term, held, strict=True):
                each[query_of[starts[i] : starts[i + 1]]] += n
            scored = np.where(np.isin(np.arange(len(ids)), _concerned(t, queries, floors, share)), each, 0)
            some = np.flatnonzero(each)
            return pa.table([ids.take(pa.array(some)), pa.array(each[some]), pa.array(scored[some])], names=schema.names)

        return self._blocks(run, schema).groupBy("query_id").agg(F.sum("n_postings").alias("n_postings"), F.sum("n_scored").alias("n_scored"))


def _concerned(t: pa.Table, queries: tuple, floors: np.ndarray, share) -> np.ndarray:
    """The queries that some document of the block could gain enough for."""
    vocabulary, starts, query_of, w = queries
    term = pc.index_in(t.column("term"), pa.array(vocabulary, pa.string())).to_numpy()
    most = share(t.column("max_tf").to_numpy().astype(np.float64), t.column("min_dl").to_numpy().astype(np.float64))
    bound, met = np.zeros(len(floors)), np.zeros(len(floors), bool)
    for i, x in zip(term, most, strict=True):
        of = query_of[starts[i] : starts[i + 1]]
        bound[of] += w[starts[i] : starts[i + 1]] * x
        met[of] = True
    return np.flatnonzero(met & (bound + _SLACK >= floors))


def _scored(t: pa.Table, ids: pa.Array, queries: tuple, asks: np.ndarray, share, k: int, names: list[str]) -> pa.Table:
    """The best k gains of a block's documents, for each of the queries ``asks``; what ties with the k-th stays."""
    vocabulary, starts, query_of, w = queries
    lists = t.column("docs").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    docs, code = coded.dictionary, coded.indices.to_numpy()
    flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy().astype(np.float64)
    x, term = share(flat("tfs"), flat("dls")), pc.index_in(t.column("term"), pa.array(vocabulary, pa.string())).to_numpy()
    ends = np.cumsum(sizes)
    out: list[tuple] = []
    for some in (asks[i : i + r.QUERY_BLOCK] for i in range(0, len(asks), r.QUERY_BLOCK)):
        local = np.full(len(ids), -1)
        local[some] = np.arange(len(some))
        gain = np.zeros((len(some), len(docs)))
        for i, n, end in zip(term, sizes, ends, strict=True):
            of = local[query_of[starts[i] : starts[i + 1]]]
            mine = of >= 0
            if mine.any():
                gain[of[mine][:, None], code[end - n : end]] += w[starts[i] : starts[i + 1]][mine][:, None] * x[end - n : end]
        if gain.size:
            q, d = r.best_of(gain, k)
            kept = gain[q, d] > 0
            out.append((some[q[kept]], d[kept], gain[q, d][kept]))
    q, d, g = (np.concatenate([o[j] for o in out]) if out else np.empty(0, kind) for j, kind in enumerate((np.int64, np.int64, np.float64)))
    return pa.table([ids.take(pa.array(q)), docs.take(pa.array(d)), pa.array(g)], names=names)
