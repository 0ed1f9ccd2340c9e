"""The stored vector table against the plain search: same rows, fewer vectors compared; passes of queries; lengths that differ."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators import retrieval, vectors
from pagequarry.plans.workflow import Hooks, Workflow
from pagequarry.sources.collections import Collections

ROWS = "doc_id long, vector array<double>"


def clustered(n, seed=1, dim=12, groups=30):
    rng = np.random.default_rng(seed)
    centres = 10 * rng.standard_normal((groups, dim))
    return [(i, (centres[i % groups] + rng.standard_normal(dim)).tolist()) for i in range(n)]


def plain(df, queries, k):
    return sorted(map(tuple, retrieval.dense_top_k(df, queries, k).collect()))


def stored(table, queries, k):
    return sorted(map(tuple, table.top_k(queries, k).collect()))


def test_rows_are_those_of_the_plain_search_and_most_vectors_are_skipped(spark, tmp_path):
    df = spark.createDataFrame(clustered(3000), ROWS)
    asked = spark.createDataFrame([(i, v) for i, v in clustered(60, seed=2)] + [(99, [0.0] * 12)], "query_id long, vector array<double>")
    table = vectors.write_vectors(df, str(tmp_path / "v"), cells=30)
    for k in (1, 15, 400):
        assert stored(table, asked, k) == plain(df, asked, k)
    report = {r.query_id: r for r in table.skipped(asked, 5).collect()}
    assert {r.n_vectors for r in report.values()} == {3000} and report[99].n_scored == 3000  # a query of zeros is as near to all
    assert sum(r.n_scored for q, r in report.items() if q != 99) < 0.5 * 60 * 3000


def test_skipped_cells_are_partitions_that_are_not_read(spark, tmp_path, capsys):
    df = spark.createDataFrame(clustered(2000), ROWS)
    table = vectors.write_vectors(df, str(tmp_path / "v"), cells=30)
    table.top_k(spark.createDataFrame(clustered(1, seed=1), ROWS).withColumnRenamed("doc_id", "query_id"), 3).explain("formatted")
    assert any("PartitionFilters" in x and "cell" in x for x in capsys.readouterr().out.splitlines())


def test_segments_repeat_safely_and_hold_what_is_odd(spark, tmp_path):
    rows = clustered(500)
    odd = [(1000, None), (1001, []), (1002, [1.0, None] + [0.0] * 10), (1003, [float("nan")] * 12), (None, [1.0] * 12), (1004, [3.0, 4.0, 0.0]), (1005, [0.0] * 12), (1006, rows[0][1]), (1007, [float("inf")] * 12)]
    first, second = spark.createDataFrame(rows[:200], ROWS), spark.createDataFrame(rows[200:] + odd, ROWS)
    table = vectors.write_vectors(first, str(tmp_path / "v"), cells=7)
    for _ in range(2):
        table.append(second, 1)
    fine = first.union(second.where("doc_id NOT IN (1000, 1001, 1002, 1003, 1007)"))
    asked = spark.createDataFrame([(0, rows[0][1]), (1, [0.0, 1.0, 0.0]), (2, [1.0]), (3, None), (4, [None] + [1.0] * 11), (None, [1.0] * 12)], "query_id long, vector array<double>")
    assert table.rows.count() == fine.count() == table.cells.agg(F.sum("n")).first()[0]
    got = stored(table, asked, 4)
    assert got == plain(fine, asked.where("query_id NOT IN (3, 4)"), 4)
    assert [(q, d) for q, d, *_ in got if q == 1] == [(1, 1004)] and not any(q in (2, 3, 4) for q, *_ in got)


def test_empty_tables_and_queries(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    table = vectors.write_vectors(none, str(tmp_path / "v"))
    asked = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, vector array<double>")
    assert table.top_k(asked).collect() == [] and [tuple(r) for r in table.skipped(asked).collect()] == [(0, 0, 0)]
    table.append(spark.createDataFrame([(7, [1.0, 1.0])], ROWS), 1)
    assert [r.doc_id for r in table.top_k(asked).collect()] == [7] and table.top_k(asked.limit(0)).collect() == []


@pytest.mark.parametrize("most_bytes", [1, 500])
def test_passes_of_queries_by_bytes(spark, tmp_path, monkeypatch, most_bytes):
    df = spark.createDataFrame(clustered(300), ROWS)
    asked = spark.createDataFrame(clustered(20, seed=2), ROWS).withColumnRenamed("doc_id", "query_id")
    whole = plain(df, asked, 5)
    table = vectors.write_vectors(df, str(tmp_path / "v"), cells=5)
    monkeypatch.setattr(retrieval, "MOST_BYTES", most_bytes * 8)
    if most_bytes == 1:
        asked = asked.where("query_id < 3")
        whole = [x for x in whole if x[0] < 3]
    assert plain(df, asked, 5) == whole == stored(table, asked, 5)


def test_vectors_of_other_lengths_do_not_meet(spark):
    """Numbers of one vector never count for another: a batch of lengths 3 and 5 was once read as two of 4."""
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [9.0, 0.0, 0.0, 0.0, 1.0]), (3, [1.0, 1.0, 0.0, 0.0])], ROWS).coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [tuple(r) for r in retrieval.dense_top_k(df, asked).collect()] == [(0, 3, 1.0, 1)]


def test_a_collection_keeps_its_vectors_and_no_query_embeds_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(str(i), f"text number {i}", "d", 1, v) for i, v in clustered(200)], "chunk_id string, text string, source_doc string, page_number long, vector array<double>")
    held = Collections(spark, str(tmp_path / "c"))
    held.save("with", chunks.withColumn("chunk_type", F.lit("text")))
    held.save("without", chunks.drop("vector").withColumn("chunk_type", F.lit("text")))
    assert held.names() == ["with", "without"] and held.vectors("without") is None and "vector" not in held.load("with").columns
    embedded = []

    def embed(rows):
        embedded.append(rows.count())
        return rows.withColumn("vector", F.array(*(F.lit(float(x)) for x in clustered(1)[0][1])))

    texts = held.load("with").withColumnRenamed("chunk_id", "doc_id")
    flow = Workflow(texts, retrieval.build_index(texts), Hooks(embed=embed), mode="dense_only", vectors=held.vectors("with"))
    found = flow.fast(spark.createDataFrame([(0, "which text is it")], "query_id int, text string")).collect()
    assert embedded == [1] and len(found) == 6 and "0" in {r.doc_id for r in found}


def test_files_of_a_folder_and_of_an_empty_one(spark, tmp_path):
    from pagequarry.sources.collections import discover_pdfs

    assert discover_pdfs(spark, str(tmp_path)).collect() == []
    for name in ("x.pdf", "y.PDF", "z.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    (tmp_path / "a=1" / "b").mkdir(parents=True)
    (tmp_path / "a=1" / "b" / "in.pdf").write_bytes(b"%PDF")
    found = discover_pdfs(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["x.pdf", "y.PDF"] and found.columns == ["path", "modificationTime", "length", "content"]
