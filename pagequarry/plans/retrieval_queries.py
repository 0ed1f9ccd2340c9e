"""Queries of retrieval: the benchmark's items ask, the documents answer; vectors are paired with texts by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators import postings
from pagequarry.operators import retrieval as r
from pagequarry.operators.vectors import write_vectors
from pagequarry.plans.catalog import query, table
from pagequarry.plans.text_queries import _TERMS
from pagequarry.sources.shared import shared_path


def _terms_of(text: str) -> str:
    return _TERMS.replace("coalesce(text, '')", text)



def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index_of(spark: SparkSession, sf_dir: str) -> r.Bm25Index:
    """All documents' postings of the terms that are asked for."""
    return r.build_index(docs_of(spark, sf_dir), queries=asked(spark, sf_dir))


BM25_SQL = f"""
tok AS (SELECT doc_id, {_TERMS} AS ts FROM INPUT_DOCS),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY ALL),
dfr AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT query_id, q.term, qtf * ln((n + 1) / df) AS w, avgdl FROM q JOIN dfr ON dfr.term = q.term, st),
base AS (SELECT query_id, sum(w) AS base FROM w GROUP BY 1),
g AS (SELECT query_id, doc_id, sum(w * tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)) AS gain FROM post JOIN w ON w.term = post.term GROUP BY 1, 2),
bm AS (SELECT g.query_id, doc_id, round(gain + base, 9) AS score FROM g JOIN base ON base.query_id = g.query_id),
bmk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 15)
"""
_BM25 = BM25_SQL.replace("INPUT_DOCS", "documents")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM bmk")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = r.bm25_top_k(index_of(spark, sf_dir), asked(spark, sf_dir))
    return top.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM bmk")
def bm25_topk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index by term that grew by a second segment."""
    docs = docs_of(spark, sf_dir)
    index = postings.build(docs.where("doc_id % 4 > 0"), shared_path(spark, "postings"))
    index.add(docs.where("doc_id % 4 = 0"), 1)
    return index.top_k(asked(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT query_id, CAST(count(*) AS BIGINT) AS n_docs, round(max(score), 4) AS best, round(min(score), 4) AS least FROM bm GROUP BY 1")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = r.bm25_scores(index_of(spark, sf_dir), asked(spark, sf_dir))
    return scores.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.round(F.max("score"), 4).alias("best"), F.round(F.min("score"), 4).alias("least"))


@query(f"WITH {_BM25} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfr) AS n_terms, (SELECT CAST(sum(tf) AS BIGINT) FROM post) AS n_tokens FROM st")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = r.build_index(docs_of(spark, sf_dir))
    terms = index.terms.agg(F.count("*").alias("n_terms"))
    tokens = index.docs.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
    return index.stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(F.broadcast(terms)).crossJoin(F.broadcast(tokens))  # one row each


_DENSE = """
dq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 9) AS score FROM embeddings, dq),
dk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 15)
"""


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 50."""
    return vectors_of(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")


@query(f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM dk")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = r.dense_top_k(vectors_of(spark, sf_dir), vector_queries(spark, sf_dir))
    return top.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM dk")
def dense_topk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored table, in two segments, of which the second came later."""
    rows = vectors_of(spark, sf_dir)
    held = write_vectors(rows.where("doc_id % 3 > 0"), shared_path(spark, "vectors"), cells=16)
    held.append(rows.where("doc_id % 3 = 0"), 1)
    return held.top_k(vector_queries(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


_FUSED = """
fu AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0::DOUBLE), 9) AS rrf,
  a.score AS ds, b.score AS ss, a.rank AS ra, b.rank AS rb FROM {a} a FULL JOIN {b} b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, ra ASC NULLS LAST, rb ASC NULLS LAST) AS rank FROM fu)
"""


# --- texts and vectors that share an id ------------------------------------------------------------------------------

_JOINT = f"""
joint AS (SELECT doc_id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
{BM25_SQL.replace("INPUT_DOCS", "joint")},
jq AS (SELECT item_id AS query_id, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
js AS (SELECT query_id, doc_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 9) AS score FROM joint, jq WHERE embedding IS NOT NULL),
jd AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM js QUALIFY rank <= 15)
"""


def joint(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All texts and all questions, with vectors where there are any."""
    chunks = docs_of(spark, sf_dir).join(vectors_of(spark, sf_dir), "doc_id", "left")
    return chunks, asked(spark, sf_dir).join(vectors_of(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id", "left")


@query(f"WITH {_JOINT}, {_FUSED.format(a='jd', b='bmk')} SELECT query_id, doc_id, rrf, CAST(coalesce(ra, 0) AS INTEGER) AS rank_dense, CAST(coalesce(rb, 0) AS INTEGER) AS rank_sparse, CAST(rank AS INTEGER) AS rank FROM fr")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of both retrievers, each fifteen long."""
    chunks, questions = joint(spark, sf_dir)
    dense, sparse = r.dense_top_k(chunks, questions), r.bm25_top_k(index_of(spark, sf_dir), questions)
    return r.fuse_ranks(dense, sparse).select("query_id", "doc_id", "rrf", "rank_dense", "rank_sparse", "rank")


def _retrieved(spark: SparkSession, sf_dir: str, mode: str, route: str = "fast") -> DataFrame:
    return r.retrieve(*joint(spark, sf_dir), mode, route)


_HYBRID = f"WITH {_JOINT}, {_FUSED.format(a='jd', b='bmk')} SELECT query_id, doc_id, rrf, round(coalesce(ds, 0), 4) AS dense_score, round(coalesce(ss, 0), 4) AS sparse_score, CAST(rank AS INTEGER) AS rank FROM fr"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "rrf", F.round("dense_score", 4).alias("dense_score"), F.round("sparse_score", 4).alias("sparse_score"), "rank")


@query(f"{_HYBRID} WHERE rank <= 6")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_retrieved(spark, sf_dir, "hybrid"))


@query(f"{_HYBRID} WHERE rank <= 8")
def hybrid_topk_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_retrieved(spark, sf_dir, "hybrid", "slow"))


@query(f"WITH {_JOINT} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS rrf, round(score, 4) AS dense_score, 0.0::DOUBLE AS sparse_score, CAST(rank AS INTEGER) AS rank FROM jd WHERE rank <= 6")
def retrieve_dense_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_retrieved(spark, sf_dir, "dense_only"))


@query(f"WITH {_JOINT} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS rrf, 0.0::DOUBLE AS dense_score, round(score, 4) AS sparse_score, CAST(rank AS INTEGER) AS rank FROM bmk WHERE rank <= 6")
def retrieve_sparse_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_retrieved(spark, sf_dir, "sparse_only"))


_JACCARD = f"""
cand AS (SELECT fr.*, d.text, b.text AS qt FROM fr JOIN documents d ON d.doc_id = fr.doc_id JOIN benchmark b ON b.item_id = fr.query_id WHERE rank <= 20),
sets AS (SELECT *, list_distinct({_TERMS}) AS x, list_distinct({_terms_of("coalesce(qt, '')")}) AS y FROM cand),
jac AS (SELECT *, coalesce(round(CAST(len(list_intersect(x, y)) AS DOUBLE) / nullif(len(list_distinct(list_concat(x, y))), 0), 9), 0.0) AS j FROM sets),
rer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, doc_id) AS rr FROM jac WHERE_CLAUSE)
"""


@query(f"WITH {_JOINT}, {_FUSED.format(a='jd', b='bmk')}, {_JACCARD.replace('WHERE_CLAUSE', 'WHERE j >= 0.15')} SELECT query_id, doc_id, round(j, 4) AS rerank_score, CAST(rr AS INTEGER) AS rank FROM rer WHERE rr <= 6")
def retrieve_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, "rerank").select("query_id", "doc_id", F.round("rerank_score", 4).alias("rerank_score"), "rank")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked_ = joint(spark, sf_dir)
    fused = r.retrieve(chunks, asked_, "hybrid", settings=r.Settings(final_fast=20))
    return fused.join(chunks.select("doc_id", "text"), "doc_id").join(asked_.select("query_id", F.col("text").alias("query_text")), "query_id")


_FAST = f"WITH {_JOINT}, {_FUSED.format(a='jd', b='bmk')}, {_JACCARD.replace('WHERE_CLAUSE', '')}"


@query(f"{_FAST} SELECT query_id, doc_id, round(j, 4) AS rerank_score, CAST(rr AS INTEGER) AS rank FROM rer WHERE rr <= 5")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.rerank(_candidates(spark, sf_dir), 5).select("query_id", "doc_id", F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query(f"{_FAST} SELECT query_id, CAST(count(*) AS BIGINT) AS n_kept FROM jac WHERE j >= 0.15 GROUP BY 1")
def rerank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.rerank(_candidates(spark, sf_dir), 20, 0.15).groupBy("query_id").agg(F.count("*").alias("n_kept"))


@query(f"{_FAST} SELECT query_id, doc_id, substr(text, 1, 300) AS text, round(rrf, 4) AS score, CAST(rank AS INTEGER) AS rank FROM cand WHERE rank <= 10")
def hybrid_search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).where("rank <= 10").select("query_id", "doc_id", F.substring("text", 1, 300).alias("text"), F.round("rrf", 4).alias("score"), "rank")


@query(f"WITH {_BM25}, m AS (SELECT query_id // 4 AS topic, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min((query_id, rank)) AS f FROM bmk WHERE rank <= 8 GROUP BY 1, 2), "
       "n AS (SELECT topic, doc_id, rrf, row_number() OVER (PARTITION BY topic ORDER BY rrf DESC, f) AS rank FROM m) SELECT topic, doc_id, rrf, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 8")  # fmt: skip
def multi_query_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = r.bm25_top_k(index_of(spark, sf_dir), asked(spark, sf_dir), 8)
    return r.fuse_queries(ranked.withColumn("topic", F.floor(F.col("query_id") / 4)), "topic")


@query(f"WITH {_BM25}, p AS (SELECT query_id // 4 AS topic, doc_id, query_id * 100 + rank AS pos FROM bmk), o AS (SELECT topic, doc_id, min(pos) AS pos FROM p GROUP BY 1, 2) SELECT topic, doc_id, pos FROM o")
def dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of several queries, each chunk where it comes first."""
    ranked = r.bm25_top_k(index_of(spark, sf_dir), asked(spark, sf_dir))
    pool = ranked.select(F.floor(F.col("query_id") / 4).alias("topic"), "doc_id", (F.col("query_id") * 100 + F.col("rank")).alias("pos"))
    first = Window.partitionBy("topic", "doc_id").orderBy("pos")
    return pool.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
