"""Pages to chunks: tables that go on over pages, captions, documents without a name."""

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import layout, tables
from pagequarry.plans import ingest

HEAD = "| Year | Revenue |\n| --- | --- |\n"
PAGES = "source_doc string, page_number int, text string"


def rows(*years):
    return "".join(f"| {y} | {y}.5 |\n" for y in years)


def table_chunks(spark, pages, **how):
    made = ingest.chunk_pages(spark.createDataFrame(pages, PAGES), **how).where("chunk_type = 'table'").collect()
    assert len({r.chunk_id for r in made}) == len(made)
    return sorted(made, key=lambda r: (r.source_doc or "", r.page_number, r.table_name))


@pytest.mark.parametrize("n", [2, 3, 20])
@pytest.mark.parametrize("repeats", [True, False])
def test_a_table_over_pages_is_one_table(spark, n, repeats):
    first = [("a", 5, "The revenue follows.\n\n" + HEAD + rows(2000, 2001))]
    more = [("a", 5 + i, (HEAD if repeats else "") + rows(2010 + i) + ("\nNothing follows." if i == n - 1 else "\n \n")) for i in range(1, n)]
    got = table_chunks(spark, first + more)
    assert len(got) == 1 and got[0].is_cross_page and got[0].page_number == 5 and got[0].page_span == list(range(5, 5 + n))
    assert got[0].text.endswith(HEAD + rows(2000, 2001, *range(2011, 2010 + n)).rstrip()) and got[0].text.count("Year") == 1


def test_what_ends_a_table(spark):
    pages = [
        ("text after", 1, HEAD + rows(1) + "The end.\n"), ("text after", 2, HEAD + rows(2)),
        ("text before", 1, HEAD + rows(1)), ("text before", 2, "Another one:\n" + HEAD + rows(2)),
        ("other columns", 1, HEAD + rows(1)), ("other columns", 2, "| a | b | c |\n| 1 | 2 | 3 |"),
        ("page without a table", 1, HEAD + rows(1)), ("page without a table", 2, "Text alone."), ("page without a table", 3, HEAD + rows(3)),
        ("missing page", 1, HEAD + rows(1)), ("missing page", 3, HEAD + rows(3)),
        ("two on a page", 1, HEAD + rows(1) + "\nbetween\n" + HEAD + rows(2)), ("two on a page", 2, HEAD + rows(3) + "\nbetween\n" + HEAD + rows(4)), ("two on a page", 3, HEAD + rows(5)),
        (None, 1, HEAD + rows(1)), (None, 2, "next"),
    ]
    got = table_chunks(spark, pages)
    spans = {}
    for r in got:
        spans.setdefault(r.source_doc, []).append(r.page_span)
    assert spans.pop("two on a page") == [[1], [1, 2], [2, 3]]
    assert spans.pop(None) == [[1]] and spans.pop("page without a table") == [[1], [3]] and spans.pop("missing page") == [[1], [3]]
    assert spans == {k: [[1], [2]] for k in ("text after", "text before", "other columns")} and not any(r.is_cross_page for r in got if r.source_doc in spans)


def test_a_long_joined_table_is_cut_after_joining(spark):
    pages = [("a", i, HEAD + rows(*range(10 * i, 10 * i + 10))) for i in range(1, 5)]
    got = table_chunks(spark, pages, table_rows=15)
    assert [r.page_span for r in got] == [[1, 2, 3, 4]] * 3 and sum(r.text.count(".5 |") for r in got) == 40


def test_chains_take_the_first_claim_and_follow_lanes(spark):
    made = [(1, 10, 0, 100, 40), (1, 11, 0, 100, 60), (2, 20, 0, 100, 60), (2, 21, 0, 100, 41), (3, 30, 0, 50, 60), (4, 40, 0, 100, 60), (1, 12, 0, 100, 40), (2, 22, 50, 100, 40)]
    df = spark.createDataFrame(made, "page int, region int, y1 int, y2 int, x2 int").withColumns({"doc": F.lit("d"), "label": F.lit("table"), "page_height": F.lit(100.0), "x1": F.lit(0.0)})
    got = {r.region: (r.chain_region, r.fragment, r.n_fragments) for r in layout.table_chains(df.withColumn("box", F.struct("x1", *(F.col(c).cast("double").alias(c) for c in ("y1", "x2", "y2"))))).collect()}
    assert got == {10: (10, 0, 2), 21: (10, 1, 2), 11: (11, 0, 3), 20: (11, 1, 3), 30: (11, 2, 3), 40: (40, 0, 1), 12: (12, 0, 1), 22: (22, 0, 1)}


def test_captions_of_charts_from_a_layout_model(spark):
    def model(pages):
        box = lambda y1, y2: F.struct(F.lit(0.0).alias("x1"), F.lit(float(y1)).alias("y1"), F.lit(9.0).alias("x2"), F.lit(float(y2)).alias("y2"))
        found = [("text", "Figure 3: sales by year", "", box(0, 10)), ("chart", "2023: 4\n2024: 5", "", box(20, 60)), ("chart", "2023: 1", "its own", box(70, 90)), ("text", "far away", "", box(95, 99))]
        regions = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text"), F.lit(c).alias("caption"), b.alias("box")) for k, t, c, b in found))
        return pages.select("source_doc", "page_number", F.posexplode(regions).alias("pos", "r")).select("source_doc", "page_number", "pos", "r.*", F.lit(100.0).alias("page_height"))

    pages = spark.createDataFrame([("a", 1, ""), (None, 1, "")], PAGES)
    got = [r.text for r in ingest.chunk_pages(pages, ingest.IngestHooks(layout=model)).where("chunk_type = 'chart'").collect()]
    assert len(got) == 4 and sum("Caption: Figure 3: sales by year" in t for t in got) == 1 and sum("Caption: its own" in t for t in got) == 2


def test_fragments_join_row_by_row(spark):
    one = spark.createDataFrame([([[["h"], ["1"]], [["h"], ["2"]], [["3"]], []],), ([[["h"]]],), ([[], [["x"]]],)], "f array<array<array<string>>>")
    assert [r.j for r in one.select(tables.join_fragments(F.col("f")).alias("j")).collect()] == [[["h"], ["1"], ["2"], ["3"]], [["h"]], [["x"]]]


def test_tables_are_made_from_the_pages_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    pages = [("a", i, HEAD + rows(2000 + i)) for i in range(1, 5)]
    model = lambda p: ingest.place_regions(p.mapInArrow(counted, p.schema))
    got = table_chunks(spark, pages, hooks=ingest.IngestHooks(layout=model))
    assert len(got) == 1 and got[0].page_span == [1, 2, 3, 4] and seen.value == 4
