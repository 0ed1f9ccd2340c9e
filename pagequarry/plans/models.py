"""Language models over many rows: prompts in batches with retries, replies that are remembered, an error for each row that failed.

A model is asked once for each different prompt, whatever number of rows has it, and never again for one that it has answered: replies
are kept in Parquet under the model's name and a hash of the prompt. A prompt that fails has its error in the rows of this run, isn't kept, and
is asked again by the next run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prompts to replies, in their order; an exception concerns all of them.
Chat = Callable[[list[str]], list[str]]
_STORED = "key string, reply string, error string, run string"


@dataclass(frozen=True)
class Remembered:
    """``load`` makes the model once in each task; ``name`` tells models and their settings apart; ``path`` is a folder that all executors reach."""

    load: Callable[[], Chat]
    path: str
    name: str
    at_once: int = 16
    tries: int = 3
    wait_seconds: float = 1.0

    def ask(self, rows: DataFrame, prompt: Column) -> DataFrame:
        """``rows`` with reply and error, one of which is null; both where the prompt is. Columns of these names are replaced."""
        spark, at, run = rows.sparkSession, f"{self.path}/{self.name}", uuid.uuid4().hex
        key = F.sha2(prompt, 256)
        asked = rows.drop("reply", "error").withColumn("_key", key)
        spark.createDataFrame([], _STORED).write.mode("append").partitionBy("run").parquet(at)
        stored = spark.read.schema(_STORED).parquet(at)
        different = asked.select(F.col("_key").alias("key"), prompt.alias("prompt")).where("prompt IS NOT NULL").groupBy("key").agg(F.first("prompt").alias("prompt"))
        new = different.join(stored.where("reply IS NOT NULL").select("key"), "key", "left_anti")
        answered = new.mapInArrow(self._answers(), "key string, reply string, error string").withColumn("run", F.lit(run))
        answered.write.mode("append").partitionBy("run").parquet(at)
        held = spark.read.schema(_STORED).parquet(at).where(F.col("reply").isNotNull() | (F.col("run") == run))
        replies = held.groupBy(F.col("key").alias("_key")).agg(F.min("reply").alias("reply"), F.min("error").alias("_error"))
        return asked.join(replies, "_key", "left").withColumn("error", F.when(F.col("reply").isNull(), F.col("_error"))).drop("_key", "_error")

    def _answers(self):
        load, at_once, tries, wait = self.load, self.at_once, self.tries, self.wait_seconds

        def tried(chat: Chat, prompts: list[str]) -> tuple[list[str | None], str | None]:
            for turn in range(tries):
                try:
                    replies = chat(prompts)
                    if len(replies) != len(prompts):
                        raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
                    return replies, None
                except Exception as error:  # what a model raises is its own
                    said = f"{type(error).__name__}: {error}"
                    if turn + 1 < tries:
                        time.sleep(wait * 2**turn)
            return [None] * len(prompts), said

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chat = None
            for batch in batches:
                for part in (batch.slice(i, at_once) for i in range(0, len(batch), at_once)):
                    chat = chat or load()
                    prompts = part.column(1).to_pylist()
                    replies, error = tried(chat, prompts)
                    errors = [error] * len(prompts)
                    if error and len(prompts) > 1:  # one bad prompt must not fail its neighbours
                        each = [tried(chat, [p]) for p in prompts]
                        replies, errors = [r[0] for r, _ in each], [e for _, e in each]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["key", "reply", "error"])

        return run
