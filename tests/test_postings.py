"""The stored index by term against the plain one: same rows, fewer postings; segments, streams, merging; what a partial index refuses."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import postings, retrieval
from pagequarry.streaming import incremental

DOCS, ASKED = "doc_id long, text string", "query_id long, text string"


def corpus(n, seed=3, topics=20):
    """Documents of a few words of their topic and many of all."""
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices([f"topic{i * topics // n}word{j}" for j in range(15)], k=8) + rng.choices([f"common{j}" for j in range(40)], k=rng.randrange(5, 40)))) for i in range(n)]


def questions(n, seed=4, topics=20):
    rng = random.Random(seed)
    return [(q, " ".join(f"topic{q % topics}word{rng.randrange(15)}" for _ in range(3)) + f" common{rng.randrange(40)}") for q in range(n)]


def same(index, docs, asked, k):
    want = sorted(map(tuple, retrieval.bm25_top_k(retrieval.build_index(docs), asked, k).collect()))
    got = sorted(map(tuple, index.top_k(asked, k).collect()))
    assert got == want
    return got


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(corpus(3000), DOCS).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    docs = spark.read.parquet(path)  # in order, so that a block has one topic or two
    return docs, postings.build(docs, str(tmp_path_factory.mktemp("index")))


def test_rows_are_those_of_the_plain_index_and_blocks_are_skipped(spark, held):
    docs, index = held
    asked = spark.createDataFrame(questions(30) + [(90, "nothing here is known"), (91, None), (92, "common1 common1 common2")], ASKED)
    for k in (1, 15):
        same(index, docs, asked, k)
    scored = [index.skipped(asked, k).agg(F.sum("n_postings").alias("all"), F.sum("n_scored").alias("n")).first() for k in (1, 15, 2000)]
    assert scored[0].n <= scored[1].n <= scored[2].n and scored[1].n < 0.5 * scored[1]["all"] and len({s["all"] for s in scored}) == 1
    asked_for = index.postings.where(F.col("term") == "topic3word4")
    assert {r.block for r in asked_for.collect()} and index.postings.groupBy("term", "block").agg(F.sum(F.size("docs")).alias("n")).agg(F.max("n")).first()[0] <= postings.BLOCK


def test_only_asked_buckets_are_read(spark, held, capsys):
    held[1].top_k(spark.createDataFrame([(0, "topic1word1")], ASKED), 3).explain("formatted")
    lines = capsys.readouterr().out.splitlines()
    assert any("PartitionFilters" in x and "bucket" in x for x in lines) and any("PushedFilters" in x and "term" in x for x in lines)


@pytest.mark.parametrize("limits", [("MOST_FILTERED", 1), ("RAREST", 1), ("FIRST_BLOCKS", 1)])
def test_limits_change_the_way_and_not_the_rows(spark, held, monkeypatch, limits):
    monkeypatch.setattr(postings, *limits)
    same(held[1], held[0], spark.createDataFrame(questions(8), ASKED), 7)


def test_passes_and_blocks_of_queries(spark, held, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    same(held[1], held[0], spark.createDataFrame(questions(11), ASKED), 5)


def test_segments_repeat_safely_and_merge(spark, tmp_path):
    rows = corpus(400) + [(1000, None), (1001, ""), (1002, "common1"), (1003, "common1")]
    docs, asked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(questions(6) + [(7, "common1")], ASKED)
    index = postings.build(docs.where("doc_id < 100"), str(tmp_path / "i"))
    for segment, where in ((1, "doc_id BETWEEN 100 AND 299"), (2, "doc_id >= 300"), (1, "doc_id BETWEEN 100 AND 299")):
        index.add(docs.where(where), segment)
    whole = same(index, docs, asked, 9)
    merged = postings.merge(index, str(tmp_path / "m"))
    assert index.segments == [0, 1, 2] and merged.segments == [0] and same(merged, docs, asked, 9) == whole
    assert merged.docs.count() == 404 and merged.stats.first().n_docs == 404 and merged.postings.count() < index.postings.count()


def test_an_index_grown_by_a_stream_equals_a_rebuilt_one(spark, tmp_path):
    rows = [(str(i), t) for i, t in corpus(300)]
    schema = "chunk_id string, text string"
    asked = spark.createDataFrame(questions(6), ASKED)
    for part in (rows[:100], rows[100:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.index_stream(arriving, str(tmp_path / "i"), str(tmp_path / "cp")).awaitTermination(120)
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    assert index.segments == [0, 1, 2]
    same(index, spark.createDataFrame(rows, "doc_id string, text string"), asked, 5)


def test_empty_index_and_no_queries(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    index = postings.build(docs, str(tmp_path / "i"))
    assert index.top_k(spark.createDataFrame(questions(2), ASKED)).collect() == []
    index.add(spark.createDataFrame([(5, "topic0word1"), (6, None)], DOCS), 1)
    assert [(r.query_id, r.doc_id) for r in index.top_k(spark.createDataFrame([(0, "topic0word1")], ASKED)).orderBy("rank").collect()] == [(0, 5), (0, 6)]
    assert index.top_k(spark.createDataFrame([], ASKED)).collect() == []


def test_a_partial_index_refuses_what_it_was_not_built_for(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "plum")], DOCS)
    index = retrieval.build_index(docs, queries=spark.createDataFrame([(0, "apple")], ASKED))
    assert retrieval.bm25_top_k(index, spark.createDataFrame([(5, "apple apple")], ASKED), 1).first().doc_id == 1
    other = spark.createDataFrame([(0, "apple plum")], ASKED)
    for call in (lambda: retrieval.bm25_top_k(index, other), lambda: retrieval.bm25_scores(index, other), lambda: retrieval.save_index(index, "/nowhere")):
        with pytest.raises(ValueError):
            call()


def test_retrieve_takes_either_index(spark, held):
    docs, index = held
    asked = spark.createDataFrame(questions(5), ASKED)
    rows = lambda i: sorted(map(str, retrieval.retrieve(docs, asked, "sparse_only", index=i).collect()))
    assert rows(index) == rows(retrieval.build_index(docs))


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    counted = retrieval._counted

    def watched(asked):
        run = counted(asked)

        def small(batches):
            for b in batches:
                assert b.nbytes < 9_000_000, b.nbytes
                yield from run(iter([b]))

        return small

    monkeypatch.setattr(retrieval, "_counted", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))  # 16 MB of terms a task
    assert retrieval.build_index(docs).stats.first() == (4000, 2000.0) and spark.conf.get(key) == before


def test_counted_terms_are_scored_in_small_batches(spark, monkeypatch):
    terms = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.struct(F.concat(F.lit("w"), i).alias("term"), F.lit(1).cast("long").alias("tf")))
    docs = spark.range(0, 2000, numPartitions=2).select(F.col("id").alias("doc_id"), F.lit(2000).alias("dl"), terms.alias("terms"))  # over 30 MB a task
    index = retrieval.Bm25Index(docs, spark.createDataFrame([("w7", 2000)], "term string, df long"), spark.createDataFrame([(2000, 2000.0)], "n_docs long, avgdl double"))
    plain = type(docs).mapInArrow

    def watched(self, run, schema, **more):
        def small(batches):
            for b in batches:
                assert b.nbytes < 9_000_000, b.nbytes
                yield from run(iter([b]))

        return plain(self, small, schema, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    top = retrieval.bm25_top_k(index, spark.createDataFrame([(1, "w7")], ASKED), 2).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [0, 1] and spark.conf.get(key) == before


def test_blocks_stay_whole_wherever_batches_end():
    rows = pa.record_batch({"block": pa.array([0] * 5 + [1] * 3 + [7] * 4), "doc_id": pa.array(range(12)), "dl": pa.array([2] * 12, pa.int32()), "terms": pa.array([[{"term": "a", "tf": 1}, {"term": f"t{i % 2}", "tf": 1}] for i in range(12)])})
    made = lambda *cuts: sorted(str(x) for b in postings._by_term(rows.slice(i, j - i) for i, j in zip((0, *cuts), (*cuts, 12), strict=True)) for x in b.to_pylist())
    whole = made()
    assert len(whole) == 9 and all(made(*cuts) == whole for cuts in ((3,), (5,), (2, 4), (4, 4, 9), (5, 8), tuple(range(1, 12))))
