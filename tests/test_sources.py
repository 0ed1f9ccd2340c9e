"""Positions of lines over many files and splits; pages of text files and of rendered ones, as a batch and as a stream."""

import pytest

from pagequarry.sources import lines, pages
from pagequarry.sources.collections import align_files


@pytest.mark.parametrize("split", [40, 1000, 128_000_000])
def test_lines_are_numbered_as_a_reader_would(spark, tmp_path, split):
    want = []
    for f, n in (("part-2", 57), ("part-0", 100), ("part-1", 0), ("part-3", 1)):
        (tmp_path / f).write_text("".join(f"{f} line {i}\n" + ("\n" if i % 7 == 0 else "") for i in range(n)))
    for f in sorted(p.name for p in tmp_path.iterdir()):
        want += [(f, x) for x in (tmp_path / f).read_text().splitlines()]
    key = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = sorted((r.line, r.file.rsplit("/", 1)[1], r.text) for r in lines.numbered_lines(spark, str(tmp_path)).collect())
        assert got == [(i, f, x) for i, (f, x) in enumerate(want)]
        full = [(f, x) for f, x in want if x]
        rows = lines.numbered_lines(spark, str(tmp_path), kept=lines.F.col("text") != "").collect()
        assert sorted((r.line, r.text) for r in rows) == [(i, x) for i, (_, x) in enumerate(full)]
        assert sorted(r.line_in_file for r in rows if r.file.endswith("part-2")) == list(range(57))
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_evaluation_files_end_with_the_shortest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"answer": "one", "citations": ["x"]}\n\n  \n{"answer": "two"}\nno json\n')
    (tmp_path / "c.jsonl").write_text('{"contexts": ["c1", "c2"]}\n{"contexts": []}\n{"contexts": ["c3"]}\n{"contexts": ["c4"]}\n')
    (tmp_path / "q.jsonl").write_text('{"question": "q1"}\n{"question": "q2"}\n')
    path = lambda n: str(tmp_path / n)
    got = align_files(spark, path("a.jsonl"), path("c.jsonl"), path("q.jsonl")).orderBy("line").collect()
    assert [(r.line, r.answer, r.contexts, r.question) for r in got] == [(0, "one", ["c1", "c2"], "q1"), (1, "two", [], "q2")]
    got = align_files(spark, path("a.jsonl"), path("c.jsonl")).orderBy("line").collect()
    assert [(r.line, r.answer, r.question) for r in got] == [(0, "one", None), (1, "two", None), (2, None, None)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_pages_as_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("first\nline\fsecond\f\ffourth\f")
    (folder / "b.TXT").write_text(" ")
    (folder / "empty.txt").write_text("")
    (folder / "c.md").write_text("not\fthis")
    want = [("a.txt", 1, "first\nline"), ("a.txt", 2, "second"), ("a.txt", 3, ""), ("a.txt", 4, "fourth"), ("b.TXT", 1, " ")]
    assert rows(pages.text_pages(spark, str(folder))) == want
    assert rows(pages.text_pages(spark, str(folder), first=2, last=3)) == want[1:3] and rows(pages.text_pages(spark, str(folder), first=9)) == []
    assert rows(pages.count_pages(pages.text_pages(spark, str(folder)))) == [("a.txt", 4), ("b.TXT", 1)]
    for name, text in (("", None), ("d.txt", "late\fcomer")):
        if text:
            (folder / name).write_text(text)
        stream = pages.text_pages(spark, str(folder), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
        stream.trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted([*want, ("d.txt", 1, "late"), ("d.txt", 2, "comer")], key=str)


def test_rendered_pages(spark, tmp_path):
    def load():
        def render(content):
            if content.startswith(b"broken"):
                raise ValueError("not a document")
            for page in content.decode().split("|"):
                if page == "never":
                    raise AssertionError("a page after the last was asked for")
                yield page

        return render

    for name, content in (("a.pdf", "|".join(f"p{i}" for i in range(200))), ("b.PDF", "one|two|never"), ("c.pdf", "broken")):
        (tmp_path / name).write_text(content)
    found = pages.files(spark, str(tmp_path))
    got = pages.render_pages(found, load, last=2)
    assert rows(got) == [("a.pdf", 1, "p0"), ("a.pdf", 2, "p1"), ("b.PDF", 1, "one"), ("b.PDF", 2, "two"), ("c.pdf", None, "ValueError: not a document")]
    whole = pages.render_pages(found.where("path like '%a.pdf'"), load)
    assert [t for _, _, t in sorted(whole.collect(), key=lambda r: r.page_number)] == [f"p{i}" for i in range(200)] and rows(pages.count_pages(whole)) == [("a.pdf", 200)]
    assert rows(pages.render_pages(found.where("path like '%a.pdf'"), load, first=199, last=300)) == [("a.pdf", 199, "p198"), ("a.pdf", 200, "p199")]


def test_evaluation_files_have_more_parts_where_they_are_longer(spark, sf, tmp_path, monkeypatch):
    from pagequarry.plans import workflow_queries

    monkeypatch.setattr(workflow_queries, "_LINES_A_PART", 20, raising=False)
    monkeypatch.setattr(workflow_queries, "shared_path", lambda *_: str(tmp_path))
    workflow_queries.eval_align_files(spark, sf)
    assert all(len(list((tmp_path / name).glob("part-*"))) > 5 for name in ("contexts", "questions"))
