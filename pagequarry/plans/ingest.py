"""From pages to a collection: regions of each page, tables joined over pages, captions, chunks of each kind, vectors.

A page source is any DataFrame (source_doc, page_number, text); what renders documents into pages stays outside. Models are hooks:
functions from a DataFrame to a DataFrame. Without one, tables are the runs of lines that begin with a bar, and the rest is text.

Regions that have a ``box`` and a ``page_height`` take part in what spans regions: a table at a page's lower edge goes on in the
table of the same width at the top of the next page, over as many pages as there are, and is cut into chunks as one; a chart
without a caption takes the nearest text above it.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import correct_ocr, count_spaced
from pagequarry.operators import charts, chunking, layout, tables
from pagequarry.sources.shared import shared_path

Step = Callable[[DataFrame], DataFrame]
_TABLE = r"(?m)((?:^[ \t]*\|[^\n]*(?:\n|$))+)"


_RUN = r"(?m)((?:^[ \t]*\|[^\n]*(?:\n|$))+|(?:^(?![ \t]*\|)[^\n]*(?:\n|$))+)"
_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def place_regions(pages: DataFrame) -> DataFrame:
    """The layout without a model: (source_doc, page_number, pos, kind, text, caption, box, page_height), Markdown tables apart from the text.

    A page is ten points high for each run of table lines or of other lines that aren't all blank; a table is as wide as its first
    row has cells. The text, which is what is left without the tables, has no box.
    """
    text = F.coalesce("text", F.lit(""))
    held = F.filter(F.regexp_extract_all(text, F.lit(_RUN), F.lit(1)), lambda x: F.regexp_like(x, F.lit(r"\S")))
    at = F.filter(F.transform(held, lambda x, i: F.when(F.regexp_like(x, F.lit(r"^[ \t]*\|")), i)), lambda i: i.isNotNull())
    rest = F.array(F.struct(F.lit("text").alias("kind"), F.regexp_replace(text, _TABLE, "").alias("text"), F.lit(None).cast(_BOX).alias("box")))

    def table(x: Column, i: Column) -> Column:
        wide = F.greatest(F.size(tables.header(tables.parse_markdown(x, keep_empty=True))), F.lit(1)).cast("double")
        box = F.struct(F.lit(0.0).alias("x1"), (i * 10.0).cast("double").alias("y1"), wide.alias("x2"), (i * 10.0 + 10.0).cast("double").alias("y2"))
        return F.struct(F.lit("table").alias("kind"), x.alias("text"), box.alias("box"))

    found = F.zip_with(F.regexp_extract_all(text, F.lit(_TABLE), F.lit(1)), at, table)
    rows = pages.select("source_doc", "page_number", (F.size(held) * 10.0).cast("double").alias("page_height"), F.posexplode(F.concat(rest, found)).alias("pos", "r"))
    return rows.select("source_doc", "page_number", "pos", "r.kind", "r.text", F.lit("").alias("caption"), "r.box", "page_height")


def split_regions(pages: DataFrame) -> DataFrame:
    """``place_regions`` without places: what is on one page stays apart from what is on others."""
    return place_regions(pages).drop("box", "page_height")


def _spans(regions: DataFrame) -> DataFrame:
    """Regions as the layout operators take them."""
    label = F.when(F.col("kind").isin(layout.LABELS), F.col("kind")).otherwise("other")
    return regions.select(F.col("source_doc").alias("doc"), F.col("page_number").alias("page"), F.col("pos").alias("region"), label.alias("label"), "box", "page_height", "text")


def _same_region(regions: DataFrame, spans: DataFrame) -> Column:
    """Documents and pages without a name stay with their own."""
    return regions["source_doc"].eqNullSafe(spans["doc"]) & regions["page_number"].eqNullSafe(spans["page"]) & (regions["pos"] == spans["region"])


def with_captions(regions: DataFrame) -> DataFrame:
    """Charts without a caption take the nearest text above them."""
    drawn, near = regions.where(F.col("kind") == "chart"), layout.captions(_spans(regions)).withColumnRenamed("caption", "_near")
    taken = F.coalesce(F.nullif(F.coalesce("caption", F.lit("")), F.lit("")), "_near", F.lit(""))
    return drawn.join(near, _same_region(drawn, near), "left").withColumn("caption", taken).select(*regions.columns)


def join_pages(recovered: DataFrame) -> DataFrame:
    """Table regions with rows (source_doc, page_number, pos, kind, caption, rows, box, page_height), those of one table joined: one row for
    each table, at its first fragment's place, with ``pages``, the pages that it is on.

    The regions are written to the shared folder first: the chains ask for their places three times and the join for their rows, and
    each would make them from the pages again.
    """
    spark, path = recovered.sparkSession, shared_path(recovered.sparkSession, "tables")
    found = recovered.select("source_doc", "page_number", "pos", "kind", F.col("caption").cast("string").alias("caption"), "rows", "box", "page_height")
    found.write.parquet(path)
    held = spark.read.schema(found.schema).parquet(path)
    chains = layout.table_chains(_spans(held.withColumn("text", F.lit(""))))
    parts = held.join(chains, _same_region(held, chains))
    part = F.struct("fragment", F.col("page_number").cast("long").alias("page"), "rows", "caption")
    whole = parts.groupBy("source_doc", F.col("chain_page").alias("page_number"), F.col("chain_region").alias("pos")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select(
        "source_doc", "page_number", "pos", F.get("parts.caption", F.lit(0)).alias("caption"), tables.join_fragments(F.col("parts.rows")).alias("rows"), F.col("parts.page").alias("pages"),
    )


def recover_tables(regions: DataFrame) -> DataFrame:
    """Table regions as (…, rows): the structure without a model is what Markdown, comma- or tab-separated text says."""
    markdown = tables.parse_markdown(F.col("text"), keep_empty=True)
    return regions.withColumn("rows", F.when(F.size(markdown) > 0, markdown).otherwise(tables.parse_delimited(F.col("text"))))


@dataclass(frozen=True)
class IngestHooks:
    """``layout``: pages to regions. ``structure``: table regions to regions with rows. ``read_cells``: cell texts, as an
    array<array<string>> column, to corrected ones. ``embed``: chunks to chunks with a vector."""

    layout: Step = place_regions
    structure: Step = recover_tables
    read_cells: Callable[[Column], Column] | None = None
    embed: Step | None = None


def correct_cells(rows: Column, language: str = "mixed") -> Column:
    """The correction of recognised characters, for every cell."""
    return F.transform(rows, lambda row: F.transform(row, lambda cell: correct_ocr(cell, F.lit(language))))


def _id(kind: str) -> Column:
    parts = (F.col("source_doc"), F.col("page_number").cast("string"), F.lit(kind), F.col("chunk_index").cast("string"))
    return F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 16)


def chunk_pages(pages: DataFrame, hooks: IngestHooks = IngestHooks(), most: int = 512, overlap: int = 64, table_rows: int = 50) -> DataFrame:
    """Chunks (chunk_id, text, source_doc, page_number, token_count, chunk_type, …) of all kinds, with stable ids.

    A table over several pages has its first page's number, and all of them in ``page_span``.
    """
    regions = hooks.layout(pages.select("source_doc", "page_number", "text"))
    placed = {"box", "page_height"} <= set(regions.columns)
    of = lambda kind: regions.where(F.col("kind") == kind)
    place = F.struct("source_doc", "page_number", "pos")
    texts = chunking.chunk_regions(of("text").select(place.alias("page"), "text"), most, overlap).select(
        "page.source_doc", "page.page_number", F.concat_ws(".", F.col("page.pos").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_index"),
        "text", F.col("token_count").cast("long").alias("token_count"), F.split("path", " > ").alias("heading_path"),
    )
    recovered = hooks.structure(of("table")).where(F.size("rows") > 0)
    rows = hooks.read_cells(F.col("rows")) if hooks.read_cells else correct_cells(F.col("rows"))
    recovered = recovered.withColumn("rows", rows)
    recovered = join_pages(recovered) if placed and {"box", "page_height"} <= set(recovered.columns) else recovered.withColumn("pages", F.array(F.col("page_number").cast("long")))
    name = F.concat(F.lit("page "), F.col("page_number").cast("string"), F.lit(" table "), F.col("pos").cast("string"))
    at = F.struct("source_doc", "page_number", "pos", "pages")
    shaped = recovered.select(
        at.alias("table_id"), F.get("rows", F.lit(0)).alias("head"), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))).alias("body"),
        name.alias("table_name"), F.coalesce("caption", F.lit("")).alias("footnote"), F.array().cast("array<string>").alias("column_units"),
    )
    cut = tables.chunk_tables(shaped, table_rows).select(
        "table_id.source_doc", "table_id.page_number", F.concat_ws(".", F.col("table_id.pos").cast("string"), F.col("part").cast("string")).alias("chunk_index"),
        "text", F.col("token_count").cast("long").alias("token_count"),
        F.concat(F.lit("page "), F.col("table_id.page_number").cast("string"), F.lit(" table "), F.col("table_id.pos").cast("string")).alias("table_name"),
        (F.size("table_id.pages") > 1).alias("is_cross_page"), F.col("table_id.pages").alias("page_span"),
    )
    charted = with_captions(regions) if placed else of("chart")
    drawn = charts.chunk_text(charts.extract_charts(charted.withColumn("page", F.col("page_number")))).select(
        "source_doc", "page_number", F.col("pos").cast("string").alias("chunk_index"), F.col("chunk").alias("text"), F.col("token_count").cast("long").alias("token_count"), "chart_type", "title",
    )
    kinds = [x.withColumns({"chunk_id": _id(kind), "chunk_type": F.lit(kind)}).drop("chunk_index") for kind, x in (("text", texts), ("table", cut), ("chart", drawn))]
    chunks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds).withColumn("page_number", F.col("page_number").cast("long"))
    return hooks.embed(chunks) if hooks.embed else chunks


#: What stands in for a document where there is none, by heading.
MOCK_TEXTS = {
    "Financial Summary": "Revenue and net income of the year against the year before.",
    "Business Overview": "What the company sells, and to whom.",
    "Risk Factors": "What may keep the company from its targets.",
    "Outlook": "What the company expects of the next year.",
}


def mock_chunks(spark: SparkSession, source_doc: str) -> DataFrame:
    """Four text chunks of pages 1 to 4, for trials without a renderer."""
    rows = [(source_doc, i, head, text) for i, (head, text) in enumerate(MOCK_TEXTS.items(), 1)]
    made = spark.createDataFrame(rows, "source_doc string, page_number long, head string, text string").withColumn("chunk_index", F.lit("0"))
    words = count_spaced(F.concat_ws(" ", "head", "text")).cast("long")
    return made.select(_id("text").alias("chunk_id"), "text", "source_doc", "page_number", words.alias("token_count"), F.array("head").alias("heading_path"), F.lit("text").alias("chunk_type"))


def back_up(path: str, folder: str) -> str:
    """A copy of a source file in ``folder``, made unless it is there; the file's new path."""
    target = os.path.join(folder, os.path.basename(path))
    if not os.path.exists(target):
        os.makedirs(folder, exist_ok=True)
        shutil.copyfile(path, target)
    return target

