"""Incremental ingest into a collection, and conversation totals over streams. Both end with the rows of a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.functions.text import count_tokens
from pagequarry.operators import postings
from pagequarry.sources.shared import exists


def ingest_stream(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append arriving chunks to a Parquet collection, each id once within an hour; ends when what is there has been read.

    ``ingested_at`` is a timestamp, as in a stored collection, so that ``Collections.load`` reads what has been streamed.
    """
    seen = chunks.withWatermark("ingested_at", "1 hour").dropDuplicatesWithinWatermark(["chunk_id"])
    writer = seen.drop("embedding").writeStream.format("parquet").partitionBy("chunk_type").option("path", target).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def index_stream(chunks: DataFrame, path: str, checkpoint: str, doc_id: str = "chunk_id") -> StreamingQuery:
    """Add arriving chunks to a stored postings index, a segment for each micro-batch; ends when what is there has been read.

    A batch that runs again replaces its segment, so that the index ends like one that was built from all chunks at once. The first
    run makes the index; ids are those of new chunks (``ingest_stream`` takes each once).
    """
    spark = chunks.sparkSession
    if not exists(spark, f"{path}/kind"):
        postings.create(spark, path, chunks.schema[doc_id].dataType.simpleString())
    index = postings.PostingsIndex(spark, path)
    add = lambda batch, number: index.add(batch, number, doc_id)
    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory_totals_stream(turns: DataFrame, target: str, checkpoint: str, event_time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Running token totals of conversations from arriving turns (conv_id, turn, role, text); a repeated turn counts once.

    The state of a conversation is its total and the numbers of its turns seen. With ``event_time``, a column of the turns' times,
    a turn's number is forgotten when it is ``late`` behind the newest, so that the state of repeats stays bounded; without it, every
    number is kept. Each micro-batch replaces the totals of the conversations that it touched.
    """
    if event_time:
        once = turns.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["conv_id", "turn"])
    else:
        once = turns.dropDuplicates(["conv_id", "turn"])
    totals = once.groupBy("conv_id").agg(F.sum(count_tokens(F.coalesce("text", F.lit("")))).alias("total_tokens"), F.count("*").alias("n_turns"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number:08d}")

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, target: str) -> DataFrame:
    """(conv_id, total_tokens, n_turns) after the last micro-batch that touched each conversation."""
    rows = spark.read.schema("conv_id long, total_tokens long, n_turns long, batch int").option("recursiveFileLookup", "true").parquet(target)
    return rows.groupBy("conv_id").agg(F.max_by("total_tokens", "batch").alias("total_tokens"), F.max_by("n_turns", "batch").alias("n_turns"))
