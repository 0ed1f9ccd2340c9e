"""Hand-derived cases of single functions and operators."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.config import Config, override, parse_overrides
from pagequarry.functions import finance, geometry, text
from pagequarry.operators import charts, chunking, memory, retrieval, tables, verify


def value(spark, column, **given):
    """The value of an expression over one row of text columns."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_terms_and_counts(spark):
    terms = lambda t: value(spark, text.search_terms(F.col("t")), t=t)
    assert terms("FY2024 netIncome rose 7.5%") == ["fy2024", "net", "income", "rose", "7.5"]
    assert terms("A b. x1") == ["b.", "x1"]
    assert value(spark, text.count_tokens(F.col("t")), t="rose 7.5% (a+b)") == 3 and value(spark, text.count_spaced(F.col("t")), t="  a b\n c ") == 3


@pytest.mark.parametrize(("line", "font", "level"), [
    ("## Overview", None, 2), ("1.2 Background", None, 3), ("1.2.3.4 Deep", None, None), ("2024 revenue rose", None, 2), ("1. Title", None, 2), ("Summary of results", None, 2), ("", None, None),
    ("Plain text", 18, 1), ("Plain text", 15, 2), ("Plain text", 13, 3), ("Plain text", 12, 4), ("Plain text", 11, None),
])
def test_headings(spark, line, font, level):
    assert value(spark, text.heading_level(F.col("t"), F.lit(font) if font else None), t=line) == level


def test_ocr_and_titles(spark):
    fix = lambda t: value(spark, text.correct_ocr(F.col("t")), t=t)
    assert fix("￥5％") == "$5%" and fix("a—b") == "a-b"
    assert value(spark, text.clean_title(F.col("t")), t="Figure 1: Revenue") == "Revenue"
    assert value(spark, text.first_fifth(F.col("t")), t="a b c d e f g h i j") == "a b [... compressed]" and value(spark, text.first_fifth(F.col("t")), t="a b c d") == " [... compressed]"
    assert value(spark, text.augment_query(F.lit("Compare"), F.array(F.lit("ROE"), F.lit("FY2024")))) == "Compare (ROE, FY2024)"


def test_heading_paths_and_blocks(spark):
    page = "## a\n### b\n## c\n### d\n# e\nsome text\n\nno"
    rows = chunking.extract_blocks(spark.createDataFrame([(1, page), (2, None), (3, "")], "doc int, text string")).orderBy("doc", "pos").collect()
    assert [r.path for r in rows if r.level] == [["## a"], ["## a", "### b"], ["## a", "## c"], ["## a", "## c", "### d"], ["# e"]]
    assert [r.content for r in rows if r.level is None] == ["some text"] and {r.doc for r in rows} == {1}
    assert rows[0].raw == "## ## a" and rows[0].content == "a"


def plain_chunks(sizes, most, overlap):
    out, now = [], []
    for i, n in enumerate(sizes):
        if now and sum(sizes[j] for j in now) + n > most:
            out.append((now[0], now[-1]))
            now = [now[-1]] if overlap else []
        now.append(i)
    return [*out, (now[0], now[-1])] if now else out


def test_packing_matches_a_plain_fold(spark):
    rng = random.Random(1)
    cases = [[rng.randrange(1, 40) for _ in range(rng.randrange(0, 25))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<int>")
    for overlap in (True, False):
        got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", chunking.pack(F.col("n"), 50, overlap).alias("c")).collect()}
        assert got == {i: plain_chunks(c, 50, overlap) for i, c in enumerate(cases)}


def test_tables(spark):
    rows = lambda keep: value(spark, tables.parse_markdown(F.col("t"), keep), t="| H | I | J |\n|---|:-:|---|\n\n| a |  | c |\nnot a row")
    assert rows(False) == [["H", "I", "J"], ["a", "c"]] and rows(True) == [["H", "I", "J"], ["a", "", "c"]]
    md = "| Year | Total Revenue |\n|---|---|\n| FY2023 | 365B |\n| FY2024 | 1,391.5 |\n| FY2025 | n/a |"
    found = tables.metric_values(spark.createDataFrame([(md,), ("",), (None,), ("| Year |",)], "md string"), "revenue").orderBy("pos").collect()
    assert [(r.value, r.year) for r in found] == [(365.0, "FY2023"), (1391.5, "FY2024")]
    merged = tables.merge_pages(spark.createDataFrame([(0, 1, 0, ["H"]), (0, 1, 1, ["r1"]), (0, 1, 2, ["r2"]), (0, 2, 0, ["H"]), (0, 2, 1, ["r3"])], "id int, page int, row_no int, cells array<string>"), "id").first()
    assert merged.head == ["H"] and merged.body == [["r1"], ["r2"], ["r3"]]


def test_table_chunks(spark):
    make = lambda n: (n, ["K", "V"], [[str(i), "x|y"] for i in range(n)], "T", "", ["", ""])
    df = spark.createDataFrame([make(0), make(50), make(120)], "table_id int, head array<string>, body array<array<string>>, table_name string, footnote string, column_units array<string>")
    rows = tables.chunk_tables(df).orderBy("table_id", "part").collect()
    assert [(r.table_id, r.num_rows, r.is_partial) for r in rows] == [(0, 0, False), (50, 50, False), (120, 50, True), (120, 50, True), (120, 20, True)]
    assert "[continued]" not in rows[2].text and "| [continued] | K | V |" in rows[3].text and "**Section: 50**" in rows[3].text and "x\\|y" in rows[1].text


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.text("abc xyz01", min_size=1, max_size=5).filter(lambda s: s.strip()), min_size=2, max_size=2), min_size=1, max_size=6))
def test_parse_of_render(spark, cells):
    cells = [[c.strip() for c in row] for row in cells]
    df = spark.createDataFrame([(cells,)], "r array<array<string>>")
    back = df.select(tables.parse_markdown(tables.render_markdown(F.col("r")[0], tables.body(F.col("r")))).alias("v")).first().v
    assert back == cells


def test_finance(spark):
    calc = lambda m, v: spark.createDataFrame([(v,)], "v map<string,double>").select(*(c.alias(n) for c, n in zip(finance.calculate(F.lit(m), F.col("v")), "rue"))).first()
    assert calc("roe", {"net_income": 97.0, "shareholders_equity": 74.0})[:2] == (131.0811, "")
    assert calc("debt_to_equity", {"total_liabilities": 278.9, "shareholders_equity": 73.7}).r == 3.7843
    for m, v in (("roe", {"net_income": 1.0, "shareholders_equity": 0.0}), ("nothing", {}), ("roe", {"goodwill": 1.0})):
        assert calc(m, v).r is None and calc(m, v).e
    units = {"1,234.5M": 1.2345e9, "7 bn": 7e9, "3%": 0.03, "5wan": 50000.0, "-5M": None, "$1.2B": None, "1.2.3": None, "12万": 12.0}
    for t, n in units.items():
        assert value(spark, finance.normalize_units(F.col("t")), t=t) == n
    assert value(spark, finance.normalize_units(F.col("t"), cjk_units=True), t="12万") == 120000.0 and value(spark, finance.normalize_units(F.col("t"), "M"), t="2.5B") == 2500.0
    growth = lambda *x: value(spark, finance.cagr_percent(*map(F.lit, x)))
    assert growth(100.0, 121.0, 2.0) == 10.0 and growth(0.0, 1.0, 1.0) is None and growth(1.0, 1.0, 0.0) is None and growth(1.0, -1.0, 2.0) is None
    assert value(spark, finance.yoy_percent(F.lit(391.0), F.lit(365.0))) == 7.1233 and value(spark, finance.yoy_percent(F.lit(85.8), F.lit(119.6))) == -28.2609
    assert value(spark, finance.identify_metric(F.lit("software development cost"))) == "operating_profit_margin"


def test_fusion_ties(spark):
    one = lambda ids: spark.createDataFrame([(0, d, 1.0, i + 1) for i, d in enumerate(ids)], "query_id int, doc_id string, score double, rank int")
    rows = retrieval.fuse_ranks(one(["a", "b"]), one(["b", "a"])).orderBy("rank").collect()
    assert [(r.doc_id, round(r.rrf, 6)) for r in rows] == [("a", 0.032522), ("b", 0.032522)]


def test_sparse_results_are_filled(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, None), (3, "pear"), (4, "apple")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "apple"), (1, "nothing known")], "query_id long, text string")
    top = retrieval.bm25_top_k(retrieval.build_index(docs), asked, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in top] == [(0, 4), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3)] and top[3].score == 0.0


def test_saved_index_gives_the_same(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = retrieval.build_index(docs)
    retrieval.save_index(index, str(tmp_path / "index"))
    rows = lambda i: sorted(map(tuple, retrieval.bm25_top_k(i, asked, 5).collect()))
    assert rows(index) == rows(retrieval.load_index(spark, str(tmp_path / "index"))) == rows(retrieval.build_index(docs, queries=asked))


def test_dense_blocks_give_the_same(spark, sf, monkeypatch):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("doc_id < 30").select(F.col("doc_id").alias("query_id"), "vector")
    odd = vectors.union(spark.createDataFrame([(9_999, None)], vectors.schema))
    rows = lambda: sorted(map(tuple, retrieval.dense_top_k(odd, asked, 4).collect()))
    one = rows()
    assert len(one) == 120 and all(r[3] != 1 or r[0] == r[1] for r in one)  # a vector is nearest to itself
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert rows() == one and retrieval.dense_top_k(vectors.limit(0), asked, 4).isEmpty() and retrieval.dense_top_k(vectors, asked.limit(0), 4).isEmpty()


def test_citations_and_missing_data(spark):
    answers = spark.createDataFrame([(1, "A [Source: r.pdf, page 3] B [Source: x.pdf, page 9]"), (2, "none"), (3, None)], "answer_id int, answer string")
    rows = {r.answer_id: r for r in verify.verify_citations(answers, spark.createDataFrame([(1, "r.pdf", 3)], "answer_id int, doc string, page int")).collect()}
    assert (rows[1].n_found, rows[1].n_valid, rows[1].issues, rows[1].groundedness, rows[1].verified) == (2, 1, "x.pdf:9", 0.5, False)
    assert (rows[2].n_found, rows[2].n_valid, rows[2].verified, rows[2].groundedness) == (0, None, True, None)
    numbers, years, percents, level = verify.missing_data(F.lit("In 2024 revenue was 391.5, up 7%"), F.lit("revenue 391.5 in FY2023"))
    r = spark.range(1).select(numbers.alias("n"), years.alias("y"), percents.alias("p"), level.alias("l")).first()
    assert (sorted(r.n), r.y, r.p, r.l) == (["2024", "7"], ["2024"], ["7%"], "HIGH")


def test_memory(spark):
    assert memory.Budget().soft == 6963
    turns = spark.createDataFrame([(1, i, "user", "w", n, False) for i, n in enumerate([6, 5, 3])], "conv_id int, turn int, role string, text string, token_count long, is_summary boolean")
    assert [r.turn for r in memory.context(turns, 10).orderBy("turn").collect()] == [0, 2]


def test_a_long_summary_stays_whole(spark):
    turns = spark.createDataFrame([(1, i, "user", "w", 9_000, False) for i in range(6)], "conv_id int, turn int, role string, text string, token_count long, is_summary boolean")
    turns = turns.withColumn("text", F.when(F.col("turn") == 0, F.expr("repeat('abcdefghi ', 550000)")).otherwise(F.col("text")))
    [row] = memory.step(turns).select(F.length("summary").alias("n"), F.substring("summary", -11, 11).alias("end")).collect()
    assert row.n > 1_000_000 and row.end == "compressed]"


def test_boxes(spark):
    a, b = (F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), c))) for c in ((0, 0, 10, 10), (5, 5, 15, 15)))
    assert round(value(spark, geometry.iou(a, b)), 4) == round(value(spark, geometry.iou(b, a)), 4) == 0.1429 and value(spark, geometry.contains(a, b)) is False


def test_charts(spark):
    found = charts.extract_charts(spark.createDataFrame([("Revenue: 120 USD\nCost: 80", "", 1), (None, None, 2)], "text string, caption string, page int")).orderBy("page").collect()
    assert [tuple(p) for p in found[0].points] == [("Revenue", 120.0, "USD"), ("Cost", 80.0, None)] and (found[0].chart_type, found[0].low, found[0].high) == ("bar", 80.0, 120.0)
    assert found[1].chart_type == "unknown" and found[1].description == "This is a unknown chart."


def test_config():
    changed = override(Config(), parse_overrides(["retrieval.final_fast=4", "memory.soft_ratio=0.5", "ignored"]))
    assert changed.retrieval.final_fast == 4 and changed.memory.soft == 4096 and Config().retrieval.final_fast == 6
    for bad in ("nothing.x", "retrieval.nothing"):
        with pytest.raises(ValueError, match="unknown"):
            override(Config(), {bad: 1})


def test_registry(spark):
    from pagequarry.registry import build_registry

    chunks = spark.createDataFrame([(1, "apple revenue rose", "a.pdf", 1), (2, "pear cost fell", "b.pdf", 2)], "doc_id long, text string, source_doc string, page_number int")
    registry = build_registry(spark, chunks)
    assert len(registry.list()) == 17
    assert registry.call("analysis_calculate", metric="roe", values={"net_income": 97, "shareholders_equity": 74})["result"]["result"] == 131.0811
    assert registry.call("retrieval_hybrid_search", query="pear cost")["result"][0]["doc_id"] == 2
    assert registry.call("retrieval_multi_query", queries=["pear", "apple"])["result"][0]["rank"] == 1
    assert registry.call("document_cross_page_merge", fragments=[[["H"], ["r1"]], [["H"], ["r2"]]])["result"] == {"head": ["H"], "body": [["r1"], ["r2"]]}
    assert registry.call("verification_missing_data", answer="7%", evidence_chunks=[{"text": "x"}])["result"]["alert_level"] == "MEDIUM"
    assert registry.call("document_ocr_correct", cell_texts=["￥5", "x"])["result"]["num_corrected"] == 1
    assert registry.call("nothing")["error"]["code"] == -32602 and registry.call("analysis_cagr", start_value=1)["error"]["code"] == -32602
    assert registry.call("analysis_yoy_growth", current_value=1, prior_value=0)["error"]["code"] == -32603
    assert registry.bind()["verification_groundedness"](answer="a", evidence_chunks=[])["error"] == "no auditing model is set"
    assert registry.call("verification_evidence_check", question="q", evidence_chunks=[])["result"]["confidence"] == 1.0
    assert registry.call("retrieval_hybrid_search", query="pear", mode="dense_only")["error"]["code"] == -32603
    ask = lambda **x: json.loads(registry.handle(json.dumps(x)))
    assert len(ask(id=1, method="tools/list")["result"]["tools"]) == 17 and ask(id=2, method="odd")["error"]["code"] == -32601 and json.loads(registry.handle("{"))["error"]["code"] == -32700
    assert ask(id=3, method="tools/call", params={"name": "analysis_cagr", "arguments": {"start_value": 100, "end_value": 121, "years": 2}})["result"] == {"cagr_percent": 10.0}


def test_registry_with_models(spark):
    from pagequarry import hooks
    from pagequarry.registry import ToolModels, build_registry

    embed = lambda df: hooks.embed(df, hooks.hashed_embedder)
    rows = [(1, "apple revenue rose", "a.pdf", 1), (2, "pear cost fell", "b.pdf", 2), (3, None, "c.pdf", 3)]
    chunks = embed(spark.createDataFrame(rows, "doc_id long, text string, source_doc string, page_number int"))
    judge = lambda prompt: F.when(prompt.contains("pear"), 'so: {"verdict": "SUFFICIENT", "confidence": 0.9}').otherwise("no idea")
    audit = lambda prompt: F.when(prompt.contains("pear"), '{"groundedness_score": 0.5, "num_claims": 2}').otherwise("{")
    registry = build_registry(spark, chunks, models=ToolModels(embed, judge, audit))
    for mode in ("dense_only", "sparse_only", "hybrid", "rerank"):
        assert registry.call("retrieval_hybrid_search", query="pear cost", mode=mode)["result"][0]["doc_id"] == 2
    told = lambda tool, **x: registry.call(tool, **x)["result"]
    assert told("verification_evidence_check", question="q", evidence_chunks=[{"text": "pear"}])["verdict"] == "SUFFICIENT"
    assert told("verification_evidence_check", question="q", evidence_chunks=[{"text": "fig"}])["reasoning"] == "no idea"
    assert told("verification_groundedness", answer="pear", evidence_chunks=[])["groundedness_score"] == 0.5
    assert told("verification_groundedness", answer="fig", evidence_chunks=[])["error"] == "the reply can't be read"


def test_dense_ids_of_any_type_and_several_passes(spark, monkeypatch):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "doc_id string, vector array<float>")
    asked = spark.createDataFrame([("7/0", [1.0, 0.1]), ("7/1", [0.1, 1.0]), ("8/0", None)], "query_id string, vector array<float>")
    texts = spark.createDataFrame([("a", "fig pear"), ("b", "pear pear nut"), ("c", None)], "doc_id string, text string")
    words = spark.createDataFrame([("7/0", "fig"), ("7/1", "nut pear"), ("8/0", None)], "query_id string, text string")
    index = retrieval.build_index(texts)
    for most, block in ((100, 100), (1, 1)):
        monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "ROW_BLOCK", block)
        assert sorted((r.query_id, r.doc_id) for r in retrieval.dense_top_k(vectors, asked, 1).collect()) == [("7/0", "a"), ("7/1", "b")]
        top = {(r.query_id, r["rank"]): r for r in retrieval.bm25_top_k(index, words, 2).collect()}
        assert [top[q, 1].doc_id for q in ("7/0", "7/1", "8/0")] == ["a", "b", "a"] and len(top) == 6
        every = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_scores(index, words).collect()}
        assert all(top[q, k].score == every[q, top[q, k].doc_id] for q, k in (("7/0", 1), ("7/1", 1), ("7/1", 2)))


def test_pages_to_chunks_of_all_kinds(spark, tmp_path):
    from pagequarry.plans import ingest

    text = "# Revenue\nThe revenue of the year was 5 million, more than before.\n| Year | Revenue |\n| --- | --- |\n| 2024 | 5 |\nMore text follows here, of a few words."
    pages = spark.createDataFrame([("a.pdf", 1, text), ("b.pdf", 1, None)], "source_doc string, page_number int, text string")
    chunks = ingest.chunk_pages(pages).collect()
    assert sorted(r.chunk_type for r in chunks) == ["table", "text"] and len({r.chunk_id for r in chunks}) == 2
    assert "2024" in next(r.text for r in chunks if r.chunk_type == "table") and "|" not in next(r.text for r in chunks if r.chunk_type == "text")

    def layout(rows):
        return ingest.split_regions(rows).union(rows.where("source_doc = 'b.pdf'").select("source_doc", "page_number", F.lit(9), F.lit("chart"), F.lit("Sales by year\n2023: 4\n2024: 5"), F.lit("bar chart")))

    hooks = ingest.IngestHooks(layout=layout, embed=lambda df: df.withColumn("vector", F.array(F.lit(1.0))))
    drawn = [r for r in ingest.chunk_pages(pages, hooks).collect() if r.chunk_type == "chart"]
    assert len(drawn) == 1 and drawn[0].vector == [1.0] and drawn[0].source_doc == "b.pdf"
    assert [r.page_number for r in ingest.mock_chunks(spark, "m.pdf").orderBy("page_number").collect()] == [1, 2, 3, 4]
    (tmp_path / "x.pdf").write_bytes(b"1")
    first = ingest.back_up(str(tmp_path / "x.pdf"), str(tmp_path / "raw"))
    (tmp_path / "x.pdf").write_bytes(b"2")
    assert ingest.back_up(str(tmp_path / "x.pdf"), str(tmp_path / "raw")) == first and open(first, "rb").read() == b"1"


def test_spans_summaries_and_faithfulness(spark):
    from pagequarry.operators import evaluate, memory, tables

    cells = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 1, 3)], "pos int, row_span int, col_span int")
    assert sorted(r.pos for r in tables.spanning_cells(cells).collect()) == [2, 3]
    turns = spark.createDataFrame([(1, i, "user", "word " * 50) for i in range(8)] + [(2, 0, "user", "hi")], "conv_id long, turn int, role string, text string")
    cut = memory.truncate(turns, memory.Budget(tokens=100, keep=2))
    assert [(r.conv_id, r.summary.split()[0]) for r in memory.last_summary(cut).collect()] == [(1, "word")]
    assert memory.reset(turns, spark.createDataFrame([(1,)], "conv_id long")).count() == 1 and memory.full_history(turns).first().turn == 0
    row = spark.createDataFrame([("q", "It rose.", "It rose in 2024")], "q string, a string, c string")
    judged = lambda metric: row.select(evaluate.faithfulness(F.col("q"), F.col("a"), F.col("c"), metric).alias("f")).first().f
    assert judged(None).faithfulness == 1.0 and judged(lambda q, a, c: F.lit(0.3)).faithfulness == 0.3 and judged(lambda q, a, c: F.lit(None).cast("double")).error


def test_hooks(spark):
    from pagequarry import hooks

    rows = hooks.embed(spark.createDataFrame([("a b",), (None,)], "text string"), lambda: hooks.hashed_embedder(8)).collect()
    assert len(rows[0].vector) == 8 and abs(sum(x * x for x in rows[0].vector) - 1) < 1e-6
    pairs = spark.createDataFrame([(0, 1, "a", "a"), (0, 2, "a", "b")], "query_id int, doc_id int, query_text string, text string")
    scorer = hooks.pair_scorer(lambda: lambda a, b: [float(x == y) for x, y in zip(a, b)])
    assert [r.doc_id for r in retrieval.rerank(pairs, 1, scorer=scorer).collect()] == [1]


def test_streams_end_like_batches(spark, sf, tmp_path):
    from pagequarry.operators.memory import totals
    from pagequarry.sources.collections import Collections
    from pagequarry.streaming import incremental

    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns.repartition(3).union(turns.limit(10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.memory_totals_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.conv_id: r.total_tokens for r in incremental.latest_totals(spark, str(tmp_path / "out")).collect()}
    assert got == {r.conv_id: r.total_tokens for r in totals(turns).collect()}
    chunks = spark.createDataFrame([("a", "x", "text"), ("b", "y", "table"), ("a", "x", "text")], "chunk_id string, text string, chunk_type string").withColumn("ingested_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    arriving = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks"))
    incremental.ingest_stream(arriving, str(tmp_path / "c" / "streamed"), str(tmp_path / "cp2")).awaitTermination(120)
    held = Collections(spark, str(tmp_path / "c"), parquet=True)
    rows = held.load("streamed").collect()
    assert sorted((r.chunk_id, r.chunk_type, str(r.ingested_at)) for r in rows) == [("a", "text", "2024-01-01 00:00:00"), ("b", "table", "2024-01-01 00:00:00")]
    held.save("stored", chunks, "2024-01-02T00:00:00")
    again = spark.readStream.schema(held.load("stored").schema).parquet(held.path("stored"))
    incremental.ingest_stream(again, str(tmp_path / "c" / "again"), str(tmp_path / "cp3")).awaitTermination(120)
    assert held.load("again").count() == 2
    timed = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    incremental.memory_totals_stream(timed, str(tmp_path / "out2"), str(tmp_path / "cp4"), event_time="at").awaitTermination(120)
    assert {r.conv_id: r.total_tokens for r in incremental.latest_totals(spark, str(tmp_path / "out2")).collect()} == got


def test_collections_and_command_line(spark, tmp_path, capsys):
    from pagequarry import cli
    from pagequarry.sources.collections import Collections, discover_pdfs

    pages = spark.createDataFrame([("a.pdf", 1, "# Revenue\nThe revenue of the year was 5 million."), ("b.pdf", 2, "# Cost\nThe cost was lower than before.")], "source_doc string, page_number int, text string")
    pages.write.parquet(str(tmp_path / "pages"))
    spark_session = spark  # the command line takes the session that runs
    assert cli.main(["ingest", str(tmp_path / "pages"), "-c", "r", "--root", str(tmp_path / "c")]) == 0
    held = Collections(spark_session, str(tmp_path / "c"))
    assert held.names() == ["r"] and held.count_lines("r") == 2 and held.load("missing").count() == 0 and held.count_lines("missing") == 0
    assert cli.main(["ask", "What was the revenue?", "-c", "r", "--root", str(tmp_path / "c"), "--show-retrieval"]) == 0
    assert "[Source: a.pdf, page 1]" in capsys.readouterr().out
    for name in ("x.pdf", "y.PDF", "w.Pdf", "z.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert discover_pdfs(spark, str(tmp_path)).count() == 3
