"""The pipeline against a plain version of its stages, and each stage on odd rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import decontaminate, toxicity
from test_llm import brute_classes, brute_cut, empty, odd_docs, plain_encoding


def test_pipeline_matches_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r.text for r in toxicity.score_toxicity(docs, model).where("toxicity < 0.5").collect()}
    classes = brute_classes(rows, 5, 80)
    rows = {i: t for i, t in rows.items() if classes[i][1] == i}
    cut = dict(brute_cut(list(rows.items()), 13))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = set()
    for _, t in items:
        n = decontaminate._normal(t)
        windows |= {tuple(n[i : i + 10]) for i in range(max(1, len(n) - 9))}

    def clean(words):
        n = decontaminate._normal(" ".join(words))
        return not any(tuple(n[i : i + k]) in windows for k in {len(w) for w in windows} for i in range(len(n) - k + 1))

    own = plain_encoding()
    want = {i: w for i, w in cut.items() if clean(w)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(want) and all(r.round_trip for r in got)
    for r in got:
        assert own.decode(r.ids).split() == " ".join(want[r.doc_id]).split() and r.n_tokens == len(r.ids)
    assert 0 < len(got) < docs.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = {c: F.lit("own") for c in ("n_words", "n_hit", "removed", "spans", "component_id", "kept", "ids", "toxicity", "print")}
    for docs in (odd_docs(spark), odd_docs(spark).withColumns(extra), empty(spark)):
        out = stage(spark, docs, sf)
        if name != "byte_level_bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert len(rows) <= 13 and (len(rows) > 0) == (docs.count() > 0)
        if "kept" in out.columns:
            assert all(r.kept == "own" and r.n_hit == "own" for r in rows)
