"""Incremental ingest: arriving documents become chunks for retrieval.

    python -m jobs.chunk_documents --config jobs/chunk_documents.json [--set documents=PATH output=PATH checkpoint=PATH]

Input: Parquet files (doc_id, source, text, …) under ``documents``, a file or a folder that grows. A file stream with a checkpoint
takes the files that no earlier run has taken, and ends when it has read them (``availableNow``).

Output, both partitioned Parquet tables under ``output``:

* ``documents``: the ledger (doc_id, source_doc, text_sha256, n_chars) of each version of a document, by batch;
* ``chunks``: chunk_id, doc_id, source_doc, chunk_index, text, heading_level, path, num_blocks, token_count, by batch and source.

A batch replaces its own partitions in both, and looks only at the ledger of earlier batches; so one that failed half-way and runs again,
and a run that finds nothing new, leave the same rows. A document that arrives again with the same text is skipped. With another
text it is a new version: ``current_chunks`` gives the chunks of each document's last one.

Defined results: a row without an id is counted and left out; of rows of a batch that repeat an id the one with the smallest text is
taken, a null text last; a null or empty text has a ledger row and no chunks; a source that is null or empty is the partition
"unknown"; other columns are left out.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from pagequarry.operators import chunking
from pagequarry.sources.collections import first_of_each

log = logging.getLogger("jobs.chunk_documents")

LEDGER = "doc_id long, source_doc string, text_sha256 string, n_chars long, batch long"
CHUNKS = (
    "chunk_id string, doc_id long, source_doc string, chunk_index int, text string, heading_level int, path string, num_blocks int, token_count int, "
    "batch long, source string"
)


@dataclass(frozen=True)
class Settings:
    documents: str
    output: str
    checkpoint: str
    most_tokens: int = 512
    overlap: int = 64
    files_per_batch: int | None = None


@dataclass(frozen=True)
class Report:
    batches: int
    rows_read: int
    documents_new: int
    chunks_written: int


def ledger(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{output}/documents")


def chunks(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{output}/chunks")


def current_chunks(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of the last version of each document."""
    last = ledger(spark, output).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return chunks(spark, output).join(last, ["doc_id", "batch"]).drop("batch")


def _prepare(spark: SparkSession, output: str) -> None:
    """Empty tables where there are none yet, so that the first batch reads like any other."""
    for name, schema, keys in (("documents", LEDGER, ["batch"]), ("chunks", CHUNKS, ["batch", "source"])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*keys).parquet(f"{output}/{name}")


def new_versions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, source_doc, text, text_sha256): one row for each document of ``rows`` that the ledger doesn't hold with this text."""
    slim = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source_doc"), "text")
    once = first_of_each(slim, ["doc_id"], [F.asc_nulls_last("text"), "source_doc"]).withColumn("text_sha256", F.sha2("text", 256))
    last = known.groupBy("doc_id").agg(F.max_by(F.struct("text_sha256"), "batch").alias("last"))
    same = (once["doc_id"] == last["doc_id"]) & once["text_sha256"].eqNullSafe(F.col("last.text_sha256"))
    return once.join(last, same, "left_anti")


def chunk(docs: DataFrame, most_tokens: int, overlap: int) -> DataFrame:
    """The chunks of documents (doc_id, source_doc, text), without batch."""
    own = F.struct("doc_id", "source_doc")
    made = chunking.chunk_regions(docs.select(own.alias("doc"), "text"), most_tokens, overlap)
    number = F.substring(F.sha2(F.concat_ws("/", F.col("doc.doc_id").cast("string"), F.col("chunk_index").cast("string")), 256), 1, 16)
    source = F.coalesce(F.nullif("doc.source_doc", F.lit("")), F.lit("unknown"))
    return made.select(
        number.alias("chunk_id"), "doc.doc_id", "doc.source_doc", "chunk_index", "text", "heading_level", "path", "num_blocks", "token_count", source.alias("source"),
    )


def _exactly(path: str) -> str:
    """The path as a pattern that matches it alone: a file stream takes a pattern that names one file, but not the file's own path."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return path if any(c in path for c in "*?[]{}") else f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def _replace(rows: DataFrame, path: str, *keys: str) -> None:
    """Write partitions, each in place of what stood there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def run(spark: SparkSession, settings: Settings) -> Report:
    """Take the files that are new under ``settings.documents`` and add their chunks to the output."""
    _prepare(spark, settings.output)
    seen: list[tuple[int, int]] = []

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        n_rows = batch.count()  # from the files' footers
        fresh = new_versions(batch, ledger(session, settings.output).where(F.col("batch") < number)).withColumn("batch", F.lit(number).cast("long"))
        entry = fresh.select("doc_id", "source_doc", "text_sha256", F.length("text").cast("long").alias("n_chars"), "batch")
        _replace(entry, f"{settings.output}/documents", "batch")
        seen.append((number, n_rows))
        made = chunk(fresh, settings.most_tokens, settings.overlap).withColumn("batch", F.lit(number).cast("long"))
        _replace(made.hint("rebalance", "source"), f"{settings.output}/chunks", "batch", "source")  # files of even size, hot sources in several
        log.info("batch %d: read %d rows of %s", number, n_rows, settings.documents)

    schema = spark.read.parquet(settings.documents).schema
    stream = spark.readStream.schema(schema)
    if settings.files_per_batch:
        stream = stream.option("maxFilesPerTrigger", settings.files_per_batch)
    query = stream.parquet(_exactly(settings.documents)).writeStream.foreachBatch(take).option("checkpointLocation", settings.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

    def of_run(table: DataFrame) -> int:
        return table.where(F.col("batch").isin([n for n, _ in seen])).count() if seen else 0

    report = Report(len(seen), sum(n for _, n in seen), of_run(ledger(spark, settings.output)), of_run(chunks(spark, settings.output)))
    log.info("wrote %d documents' entries and %d chunks to %s", report.documents_new, report.chunks_written, settings.output)
    return report


if __name__ == "__main__":
    sys.exit(command_line(Settings, run, "chunk_documents"))
