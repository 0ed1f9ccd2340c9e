"""Pages of documents in a folder, as a batch or as a stream of arriving files: (source_doc, page_number, text), what ingest takes.

Text files have a form feed between their pages, as text renderers of paged documents write them. Other files go through a renderer, a
hook that is made once in each task and gives a file's pages in order. A file's path and bytes meet in one row, its pages don't;
where files are large, hold ``spark.sql.execution.arrow.maxRecordsPerBatch`` to a few. A file without a byte has no pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file's bytes to its pages' texts, the first page first.
Renderer = Callable[[bytes], Iterator[str]]
PAGES = "source_doc string, page_number int, text string"
_FILES = "path string, modificationTime timestamp, length long, content binary"
_AT_ONCE = 64


def files(spark: SparkSession, folder: str, suffix: str = "pdf", stream: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files with a suffix, in whatever case."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    reader = spark.readStream.schema(_FILES) if stream else spark.read
    return reader.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def render_pages(found: DataFrame, load: Callable[[], Renderer], first: int = 1, last: int | None = None) -> DataFrame:
    """Pages ``first`` to ``last`` of files; a file that the renderer fails on has one row with a null page and the error as its text.

    Pages before ``first`` are passed over as they come, and none is asked for after ``last``.
    """
    names = [c.split()[0] for c in PAGES.split(", ")]

    def rows(render: Renderer, name: str, content: bytes) -> Iterator[tuple]:
        try:
            for number, text in enumerate(render(content), 1):
                if number >= first:
                    yield name, number, text
                if last is not None and number >= last:
                    break
        except Exception as error:  # a file that can't be read doesn't end the ingest of the others
            yield name, None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, held = load(), []
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows(render, name, content.as_py() or b""):
                    held.append(row)
                    if len(held) == _AT_ONCE:
                        yield _batch(held, names)
                        held = []
        if held:
            yield _batch(held, names)

    return found.select(F.element_at(F.split("path", "/"), -1).alias("source_doc"), "content").mapInArrow(run, PAGES)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], names=names)


def text_pages(spark: SparkSession, folder: str, suffix: str = "txt", first: int = 1, last: int | None = None, stream: bool = False) -> DataFrame:
    """Pages of text files in UTF-8, without Python: a form feed ends a page, one at the end of the file begins none."""
    pages = F.split(F.regexp_replace(F.decode("content", "UTF-8"), "\f$", ""), "\f")
    wanted = F.slice(pages, first, F.greatest(F.lit(last - first + 1 if last is not None else 2**31 - 1), F.lit(0)))
    named = files(spark, folder, suffix, stream).select(F.element_at(F.split("path", "/"), -1).alias("source_doc"), wanted.alias("pages"))
    return named.select("source_doc", F.posexplode("pages").alias("at", "text")).select("source_doc", (F.col("at") + first).cast("int").alias("page_number"), "text")


def count_pages(pages: DataFrame) -> DataFrame:
    """(source_doc, n_pages): the last page of each document that was read."""
    return pages.where("page_number IS NOT NULL").groupBy("source_doc").agg(F.max("page_number").alias("n_pages"))
