"""Conversation memory that runs turn by turn: as a batch over stored turns, and as arbitrary state of a stream.

After each turn of a conversation, in the order of their numbers, the memory node looks at the stored turns: where their tokens reach the
budget, all but the newest ``keep`` go into a summary, with the summary that stood there before. ``operators.memory.step`` is the
node run once over a whole conversation; both agree where a conversation reaches its budget with its last turn, or never.

What is held of a conversation is its summary (with the stand-in, at most a fourth of what one truncation takes in), fewer turns than
reach the budget, or the newest ``keep`` ones, and the turns that wait for earlier ones. Turns that come again are told by their number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagequarry.operators.memory import SUMMARY_HEAD, Budget, with_tokens

ROW = "conv_id long, last_turn long, truncated boolean, total_tokens long, n_turns long, summary string"
_SPACE, TOKEN = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[\w.+%-]+")


def first_fifth(text: str) -> str:
    """``functions.text.first_fifth`` of a plain text."""
    words = [w for w in _SPACE.split(text) if w]
    return " ".join(words[: len(words) // 5]) + " [... compressed]"


@dataclass
class Session:
    """One conversation: what of it is stored after its turn ``upto``."""

    summary: str | None = None
    summary_tokens: int = 0
    upto: int = -1
    truncated: bool = False  # by the last turn
    kept: list[tuple[int, str, int]] = field(default_factory=list)  # turn, text, tokens

    def add(self, turn: int, text: str, tokens: int, budget: Budget, summarise: Callable[[str], str] = first_fifth) -> None:
        self.kept.append((turn, text, tokens))
        self.upto, self.truncated = turn, False
        if self.total >= budget.tokens:
            self.truncated = True
            old, self.kept = self.kept[: -budget.keep], self.kept[-budget.keep :]
            if old:
                before = [] if self.summary is None else [SUMMARY_HEAD + self.summary]
                self.summary = summarise(" ".join([*before, *(text for _, text, _ in old)]))
                self.summary_tokens = len(TOKEN.findall(self.summary))

    @property
    def total(self) -> int:
        return sum(n for *_, n in self.kept)

    def row(self, conv_id: Any, budget: Budget) -> tuple:
        """As ``ROW``: after a truncation the tokens and turns that enter the context, oldest first, as far as they fit; else all."""
        counts = [n for *_, n in self.kept] if self.summary is None else [self.summary_tokens, *(n for *_, n in self.kept)]
        total, n = self.total, len(counts)
        if self.truncated:
            total = n = 0
            for c in counts:
                if total + c <= budget.tokens:
                    total, n = total + c, n + 1
        return conv_id, self.upto, self.truncated, total, n, self.summary


def run(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(conv_id, last_turn, truncated, total_tokens, n_turns, summary) after the last turn of each conversation.

    Turns stream through their task in order, so that a conversation of any length takes no more memory than its session. Of turns
    with the same number that with the smallest text counts; rows without conversation or number are left out.
    """
    rows = with_tokens(turns.where("conv_id IS NOT NULL AND turn IS NOT NULL")).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "token_count")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROW.split(", ")]
        at, session = None, Session()
        for batch in batches:
            out = []
            for conv, turn, text, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != at:
                    if at is not None:
                        out.append(session.row(at, budget))
                    at, session = conv, Session()
                if turn > session.upto or not session.kept:
                    session.add(turn, text, tokens, budget)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], _ARROW)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, session.row(at, budget), strict=True))], _ARROW)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").mapInArrow(follow, ROW)


_ARROW = pa.schema([("conv_id", pa.int64()), ("last_turn", pa.int64()), ("truncated", pa.bool_()), ("total_tokens", pa.int64()), ("n_turns", pa.int64()), ("summary", pa.string())])


class _Keeper(StatefulProcessor):
    """A conversation's session, and the turns that wait for earlier ones.

    Turns are numbered from ``first`` without gaps. One that comes early waits until those before it have come, or until the watermark has
    passed its own time, when none of them can come any more. A conversation without a turn for ``quiet`` is forgotten.
    """

    def __init__(self, budget: Budget, first: int, quiet_ms: int | None):
        self.budget, self.first, self.quiet = budget, first, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "summary string, summary_tokens long, upto long, truncated boolean, newest long")
        self.kept = handle.getListState("kept", "turn long, text string, tokens long")
        self.waiting = handle.getMapState("waiting", "turn long", "text string, tokens long, at long")

    def _load(self) -> tuple[Session, int]:
        if not self.session.exists():
            return Session(upto=self.first - 1), 0
        summary, tokens, upto, truncated, newest = self.session.get()
        return Session(summary, tokens, upto, truncated, [tuple(k) for k in self.kept.get()] if self.kept.exists() else []), newest

    def _take(self, session: Session, newest: int, key: tuple, gone: int | None) -> Iterator[pd.DataFrame]:
        """Add what can be added; ``gone``: the watermark, which turns that still wait no longer need to wait for."""
        early = {k[0]: v for k, v in self.waiting.iterator()}
        before = session.upto
        while early:
            turn = session.upto + 1
            if turn not in early:
                turn = min(early)
                if gone is None or early[turn][2] > gone:
                    self.handle.registerTimer(early[turn][2])
                    break
            text, tokens, _ = early.pop(turn)
            self.waiting.removeKey((turn,))
            session.add(turn, text, tokens, self.budget)
        self.session.update((session.summary, session.summary_tokens, session.upto, session.truncated, newest))
        if session.upto > before:
            self.kept.put(session.kept)
            yield pd.DataFrame([session.row(key[0], self.budget)], columns=[c.split()[0] for c in ROW.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, newest = self._load()
        for part in rows:
            for turn, text, tokens, at in zip(part["turn"].tolist(), part["text"].tolist(), part["token_count"].tolist(), part["at_ms"].tolist(), strict=True):
                newest = max(newest, at)
                held = self.waiting.getValue((turn,)) if self.waiting.containsKey((turn,)) else None
                if turn > session.upto and (held is None or text < held[0]):
                    self.waiting.updateValue((turn,), (text, tokens, at))
        if self.quiet is not None:
            self.handle.registerTimer(newest + self.quiet)
        yield from self._take(session, newest, key, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, newest = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        yield from self._take(session, newest, key, now)
        if self.quiet is not None and newest + self.quiet <= now:
            for state in (self.session, self.kept, self.waiting):
                state.clear()

    def close(self) -> None:
        pass


def memory_stream(turns: DataFrame, target: str, checkpoint: str, event_time: str, budget: Budget = Budget(), late: str = "1 day", first: int = 0, quiet: str | None = None) -> StreamingQuery:
    """Run the memory node over arriving turns (conv_id, turn, role, text, and a column of times); ends when what is there has been read.

    Turns may come in any order and again. Each micro-batch writes the rows of the conversations that it changed, in place of what an
    attempt before left; ``latest_memory`` reads the last ones. State is kept in RocksDB stores, whose provider the session is set to
    while the stream starts.
    """
    spark = turns.sparkSession
    clean = with_tokens(turns.where("conv_id IS NOT NULL AND turn IS NOT NULL"))
    slim = clean.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "token_count", F.unix_millis(event_time).alias("at_ms"), F.col(event_time).alias("at"))
    quiet_ms = None if quiet is None else int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = slim.withWatermark("at", late).groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_Keeper(budget, first, quiet_ms), outputStructType=ROW, outputMode="Update", timeMode="EventTime"
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:08d}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def latest_memory(spark: SparkSession, target: str) -> DataFrame:
    """The row of each conversation after the last turn that has been added."""
    rows = spark.read.schema(f"{ROW}, batch int").option("recursiveFileLookup", "true").parquet(target)
    names = [c.split()[0] for c in ROW.split(", ")][1:]
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*names), F.struct("last_turn")).alias("r"))
    return last.select("conv_id", "r.*")
