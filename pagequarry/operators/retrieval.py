"""Dense, sparse, fused and reranked retrieval for many queries at once.

Scores are compared after rounding to nine digits and ties go to the smaller id, so that results don't depend on the order in
which a cluster adds up doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.text import search_terms
from pagequarry.sources.shared import shared_path, small_batches

#: Queries that meet a batch in one matrix product, and rows of a batch that do.
QUERY_BLOCK, ROW_BLOCK = 2_000, 1_000
#: Queries, and bytes of their vectors or weights, that one pass over the documents or vectors answers; more are answered in several passes.
MOST_QUERIES, MOST_BYTES = 100_000, 64_000_000
MOST_BROADCAST_TERMS = 500_000


@dataclass(frozen=True)
class Bm25Index:
    docs: DataFrame  # doc_id, dl, terms: array of (term, tf)
    terms: DataFrame  # term, df
    stats: DataFrame  # one row: n_docs, avgdl
    asked: DataFrame | None = None  # the terms that a partial index was built for; None: all

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf, dl"""
        return self.docs.select("doc_id", "dl", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.tf", "dl")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(search_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _counted(asked):
    """(doc_id, dl, terms) from (doc_id, terms as they stand); with ``asked``, of these terms alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else pa.array(asked.value, pa.string())
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            words, row = lists.flatten(), np.repeat(np.arange(len(b)), sizes)
            if wanted is not None:
                kept = pc.is_in(words, wanted)
                words, row = words.filter(kept), row[kept.to_numpy(zero_copy_only=False)]
            coded = words.dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            key, tf = np.unique(row * kinds + coded.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(key // kinds, np.arange(len(b) + 1))
            terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % kinds)), pa.array(tf.astype(np.int64))], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), terms)], names=["doc_id", "dl", "terms"])

    return run


def counted_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", asked=None) -> DataFrame:
    """(doc_id, dl, terms: array of (term, tf)) of documents, tokenised in as many tasks as there are cores at least.

    Write it inside ``small_batches``: a worker holds a few numbers for each word of a batch.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    files = len(docs.inputFiles()) if rows.isStreaming is False else 0
    if files < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    kind = docs.schema[doc_id].dataType.simpleString()
    tokens = rows.select("doc_id", F.coalesce(search_terms(F.coalesce("text", F.lit(""))), F.array().cast("array<string>")).alias("terms"))
    return tokens.mapInArrow(_counted(asked), f"doc_id {kind}, dl int, terms array<struct<term: string, tf: bigint>>")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", queries: DataFrame | None = None) -> Bm25Index:
    """Terms of each document, document frequencies and corpus statistics over all documents, those without terms included.

    The index is written to the shared folder. With ``queries``, it holds only what these ask for, if they ask for at most
    ``MOST_BROADCAST_TERMS`` terms; it then refuses queries that ask for others.
    """
    spark = docs.sparkSession
    asked, wanted = None, []
    if queries is not None:
        wanted = query_terms(queries).select("term").distinct().limit(MOST_BROADCAST_TERMS + 1).toArrow().column(0).to_pylist()
        if len(wanted) <= MOST_BROADCAST_TERMS:
            asked = spark.sparkContext.broadcast(wanted)
    path = shared_path(spark, "bm25-index")
    with small_batches(spark):
        counted_terms(docs, doc_id, text, asked).write.parquet(f"{path}/docs")
    if asked is not None:
        spark.createDataFrame([(t,) for t in wanted], "term string").write.parquet(f"{path}/asked")
    return _index(spark, path, asked is not None)


def _index(spark: SparkSession, path: str, partial: bool) -> Bm25Index:
    held = spark.read.parquet(f"{path}/docs")
    df = held.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df.write.mode("overwrite").parquet(f"{path}/terms")
    held.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    return replace(load_index(spark, path), asked=spark.read.parquet(f"{path}/asked") if partial else None)


def save_index(index: Bm25Index, path: str) -> None:
    """Write a whole index as Parquet to a place of its own."""
    if index.asked is not None:
        raise ValueError("an index of some queries' terms alone isn't saved")
    for name in ("docs", "terms", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "terms", "stats")))


def _weights(index, queries: DataFrame) -> DataFrame:
    """(query_id, term, w, avgdl)"""
    return weigh(queries, index.terms, index.stats)


def _check(index: Bm25Index, queries: DataFrame) -> None:
    """A partial index would be silent about terms that it wasn't built for."""
    if index.asked is not None and (odd := query_terms(queries).join(index.asked, "term", "left_anti").first()):
        raise ValueError(f"the index was built for other queries; it doesn't hold {odd.term!r}")


def weigh(queries: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, term, w, avgdl) from (term, df) and one row of statistics."""
    known = query_terms(queries).join(terms, "term").crossJoin(F.broadcast(stats))
    return known.select("query_id", "term", (F.col("qtf") * F.ln((F.col("n_docs") + 1) / F.col("df"))).alias("w"), "avgdl")


def bm25_scores(index: Bm25Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 1.0) -> DataFrame:
    """(query_id, doc_id, score) for every document that shares a term with a query (query_id, text): a row for each such pair."""
    _check(index, queries)
    weighted = _weights(index, queries)
    base = weighted.groupBy("query_id").agg(F.sum(F.col("w") * delta).alias("base"))
    gain = F.col("w") * F.col("tf") * (k1 + 1) / (k1 * (1 - b + b * F.col("dl") / F.col("avgdl")) + F.col("tf"))
    summed = index.postings.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(gain).alias("gain")).join(base, "query_id", "left")
    return summed.select("query_id", "doc_id", F.round(F.col("gain") + F.coalesce("base", F.lit(0.0)), 9).alias("score"))


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best k positive scores; ties with the k-th stay."""
    keep = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    return np.nonzero(scores >= floor[:, None])


def vector_queries(queries: DataFrame) -> DataFrame:
    """(query_id, vector, bytes) of the queries that have both."""
    rows = queries.where("query_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    return rows.select("query_id", "vector", (8 * F.size("vector")).cast("long").alias("bytes"))


def text_queries(queries: DataFrame) -> DataFrame:
    """(query_id, text, bytes) of the queries with an id; a word of the text makes two numbers."""
    return queries.where("query_id IS NOT NULL").select("query_id", "text", (8 * F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes"))


def in_passes(queries: DataFrame, run: Callable[[DataFrame], tuple[DataFrame, list]], schema: T.StructType, written: bool = False) -> DataFrame:
    """The results of queries (query_id, …, bytes) in passes of about ``MOST_QUERIES`` queries and ``MOST_BYTES`` bytes at most.

    ``run`` gives a pass's result and what it has broadcast. One pass is planned and left to the caller, unless it is to be ``written``;
    of several, each is written and its broadcasts are destroyed before the next is sent, so that driver and executors hold one at a time.
    """
    total = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-total["n"] // MOST_QUERIES), -(-total["bytes"] // MOST_BYTES))
    slim = queries.drop("bytes")
    if n == 1 and not written:
        return run(slim)[0]
    spark, path = queries.sparkSession, shared_path(queries.sparkSession, "passes")
    for i in range(n):
        part, sent = run(slim.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i))
        part.write.parquet(f"{path}/{i}")
        for s in sent:
            s.destroy()
    return spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(n)))


def top_k(scores: DataFrame, k: int, *ties: Column, score: str = "score", query: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank from 1."""
    order = [F.col(score).desc(), *(ties or (F.col("doc_id"),))]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def bm25_top_k(index: Bm25Index, queries: DataFrame, k: int = 15, k1: float = 1.5, b: float = 0.75, delta: float = 1.0) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents, those that share no term last, by their ids.

    The queries' weights go to the documents; a batch of these scores itself against a block of queries in one product and keeps
    its own best k for each, so that no row for each pair of a query and a document is made.
    """
    _check(index, queries)
    spark = queries.sparkSession
    stats = index.stats.first()
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", index.docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    average = float(stats["avgdl"] or 0.0)

    def scored(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, term_at, query_of, term_of, w = sent.value
            known = pa.array(term_at, pa.string())
            for batch in batches:
                for b_ in (batch.slice(i, ROW_BLOCK) for i in range(0, len(batch), ROW_BLOCK)):
                    lists = b_.column(2)
                    offsets = lists.offsets.to_numpy()
                    flat = lists.flatten()
                    at = pc.index_in(flat.field(0), known)
                    row = np.repeat(np.arange(len(b_)), np.diff(offsets))
                    found = at.is_valid().to_numpy(zero_copy_only=False)
                    at = at.fill_null(0).to_numpy()[found]
                    row, tf = row[found], flat.field(1).to_numpy()[found].astype(np.float64)
                    if not len(at):
                        continue
                    dl = b_.column(1).to_numpy().astype(np.float64)
                    x = tf * (k1 + 1) / (k1 * (1 - b + b * dl[row] / average) + tf)
                    here, column = np.unique(at, return_inverse=True)  # the terms of this batch alone
                    terms = np.zeros((len(here), len(b_)))
                    terms[column, row] = x
                    place = np.searchsorted(here, term_of)
                    used = (place < len(here)) & (here[np.minimum(place, len(here) - 1)] == term_of)
                    for first in range(0, len(ids), QUERY_BLOCK):
                        of = used & (query_of >= first) & (query_of < first + QUERY_BLOCK)
                        matrix = np.zeros((min(QUERY_BLOCK, len(ids) - first), len(here)))
                        matrix[query_of[of] - first, place[of]] = w[of]
                        gains = matrix @ terms
                        q, d = best_of(gains, k)
                        some = gains[q, d] > 0
                        q, d = q[some], d[some]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + first)), b_.column(0).take(pa.array(d)), pa.array(gains[q, d])], names=schema.names)

        return run

    def one(some: DataFrame) -> tuple[DataFrame, list]:
        weights = _weights(index, some).select("query_id", "term", "w").toArrow()
        ids, terms = (weights.column(c).combine_chunks().dictionary_encode() for c in (0, 1))
        sent = spark.sparkContext.broadcast((ids.dictionary, terms.dictionary.to_pylist(), ids.indices.to_numpy(), terms.indices.to_numpy(), weights.column(2).to_numpy()))
        return index.docs.select("doc_id", "dl", "terms").mapInArrow(scored(sent), schema), [sent]

    with small_batches(spark):  # a setting of the session counts when a plan runs, so the gains are written here
        gains = in_passes(text_queries(queries), one, schema, written=True)
    return rank_gains(index, queries, gains.withColumnRenamed("score", "gain"), k, delta)


def rank_gains(index, queries: DataFrame, gains: DataFrame, k: int, delta: float) -> DataFrame:
    """(query_id, doc_id, score, rank) from (query_id, doc_id, gain) of the best matches: what every document gets is added, and queries with
    fewer matches than k are filled by id."""
    first = index.docs.select("doc_id").orderBy("doc_id").limit(k)  # any query's best documents lie among its matches and these
    fill = queries.select("query_id").where("query_id IS NOT NULL").crossJoin(F.broadcast(first)).select("query_id", "doc_id", F.lit(0.0).alias("gain"))
    base = _weights(index, queries).groupBy("query_id").agg(F.sum(F.col("w") * delta).alias("base"))
    best = gains.union(fill).groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain")).join(base, "query_id", "left")
    return top_k(best.select("query_id", "doc_id", F.round(F.col("gain") + F.coalesce("base", F.lit(0.0)), 9).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of the same length, as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, vector) against all vectors (doc_id, vector), exactly.

    All vectors are read once for each pass of queries (``in_passes``), which are broadcast. A batch of vectors meets the queries of its
    length block by block in matrix products and keeps its own best k for each query, so what is shuffled is a small share of the
    pairs. Ids may have any type. Rows without id or vector match nothing, nor do vectors of different lengths one another.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", vectors.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    rows = vectors.where("doc_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").select("doc_id", "vector")

    def by_length(ids, column) -> dict[int, tuple]:
        sizes = np.diff(column.offsets.to_numpy())
        out = {}
        for size in np.unique(sizes):
            at = pa.array(np.flatnonzero(sizes == size))
            out[int(size)] = ids.take(at), column.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        return out

    def scores(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in (batch.slice(i, ROW_BLOCK) for i in range(0, len(batch), ROW_BLOCK)):
                    for size, (docs, own) in by_length(b.column(0), b.column(1)).items():
                        ids, matrix = sent.value.get(size, ([], []))
                        for first in range(0, len(ids), QUERY_BLOCK):
                            product = np.round(matrix[first : first + QUERY_BLOCK] @ own.T, 9)
                            q, d = best_of(product, k)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + first)), docs.take(pa.array(d)), pa.array(product[q, d])], names=schema.names)

        return run

    def one(some: DataFrame) -> tuple[DataFrame, list]:
        asked = some.toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast(by_length(*(c.combine_chunks() for c in asked.columns)) if len(asked) else {})
        return rows.mapInArrow(scores(sent), schema), [sent]

    return top_k(in_passes(vector_queries(queries), one, schema), k)


def fuse_ranks(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: (query_id, doc_id, rrf, dense_*, sparse_*, rank); a missing rank or score is 0.

    Ties go to the dense list's order, then to the sparse list's.
    """
    a = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("rank_dense"))
    b = sparse.select("query_id", "doc_id", F.col("score").alias("sparse_score"), F.col("rank").alias("rank_sparse"))
    both = a.join(b, ["query_id", "doc_id"], "full")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(part("rank_dense") + part("rank_sparse"), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("rank_dense").asc_nulls_last(), F.col("rank_sparse").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).select(
        "query_id", "doc_id", "rrf", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"),
        F.coalesce("rank_dense", F.lit(0)).alias("rank_dense"), F.coalesce("rank_sparse", F.lit(0)).alias("rank_sparse"), "rank",
    )


def overlap_score(a: Column, b: Column) -> Column:
    """The offline stand-in for a cross-encoder: Jaccard similarity of the search terms of two texts."""
    x, y = F.array_distinct(search_terms(a)), F.array_distinct(search_terms(b))
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), 9), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, threshold: float | None = None, scorer=overlap_score) -> DataFrame:
    """Candidates (query_id, doc_id, query_text, text, ...) by the scorer; the threshold cuts before the best k are taken."""
    scored = candidates.withColumn("rerank_score", scorer(F.col("query_text"), F.col("text")))
    if threshold is not None:
        scored = scored.where(F.col("rerank_score") >= threshold)
    return top_k(scored.drop("rank"), k, score="rerank_score")


@dataclass(frozen=True)
class Settings:
    dense_k: int = 15
    sparse_k: int = 15
    rrf_k: int = 60
    candidates: int = 20
    final_fast: int = 6
    final_slow: int = 8
    threshold: float = 0.15


def retrieve(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", route: str = "fast", settings: Settings = Settings(), index: Bm25Index | None = None, vectors=None) -> DataFrame:
    """Ranked chunks for queries (query_id, text, vector) from chunks (doc_id, text, vector); only what the mode needs is built.

    A stored ``vectors.VectorTable`` takes the place of the chunks' own vectors, a ``postings.PostingsIndex`` that of a ``Bm25Index``. Modes: dense_only, sparse_only, hybrid, rerank (hybrid candidates, reranked, with a threshold).
    """
    final = settings.final_slow if route == "slow" else settings.final_fast
    empty = lambda x: x.limit(0)
    if mode not in ("dense_only", "sparse_only", "hybrid", "rerank"):
        raise ValueError(f"unknown mode {mode}")
    dense = sparse = None
    if mode != "sparse_only":
        dense = dense_top_k(chunks, queries, settings.dense_k) if vectors is None else vectors.top_k(queries, settings.dense_k)
    if mode != "dense_only":
        held = build_index(chunks, queries=queries) if index is None else index
        sparse = bm25_top_k(held, queries, settings.sparse_k) if isinstance(held, Bm25Index) else held.top_k(queries, settings.sparse_k)
    fused = fuse_ranks(dense if dense is not None else empty(sparse), sparse if sparse is not None else empty(dense), settings.rrf_k)
    fused = fused.where(F.col("rank") <= settings.candidates)
    if mode == "rerank":
        texts = fused.join(chunks.select("doc_id", "text"), "doc_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
        return rerank(texts, final, settings.threshold).drop("text", "query_text")
    return fused.where(F.col("rank") <= final)


def fuse_queries(ranked: DataFrame, group: str, k: int = 60, final: int = 8) -> DataFrame:
    """Fuse the lists of several queries of one group: (group, doc_id, rrf, rank), each document once."""
    summed = ranked.groupBy(group, "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("query_id", "rank")).alias("first"))
    order = Window.partitionBy(group).orderBy(F.col("rrf").desc(), "first")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= final).select(group, "doc_id", "rrf", "rank")
