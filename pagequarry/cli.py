"""Command line: ingest page texts into a collection, ask it questions, serve the tools over standard input.

    python -m pagequarry.cli ingest PAGES.parquet -c reports --root DIR [--chunk-max-tokens 512 --overlap 64]
    python -m pagequarry.cli ask "What was the revenue?" -c reports --root DIR [--config-override retrieval.final_fast=4] [--show-retrieval]
    python -m pagequarry.cli chat -c reports --root DIR          (commands: history, clear, state, exit)
    python -m pagequarry.cli tools [-c reports --root DIR]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagequarry import hooks
from pagequarry.config import Config, override, parse_overrides
from pagequarry.operators import retrieval, verify
from pagequarry.operators.memory import Budget
from pagequarry.plans.ingest import IngestHooks, chunk_pages
from pagequarry.plans.workflow import Hooks, Workflow, build_citations
from pagequarry.registry import ToolModels, build_registry
from pagequarry.session import build_session
from pagequarry.sources.collections import Collections
from pagequarry.streaming.memory import TOKEN, Session


def embedded(rows):
    """Vectors of the stand-in without weights; a model takes its place through ``hooks.embed``."""
    return hooks.embed(rows, hooks.hashed_embedder)


def ingest(spark: SparkSession, pages: str, root: str, name: str, most: int, overlap: int) -> int:
    """Pages (source_doc, page_number, text) to chunks of all kinds with stable ids, their vectors and their index; returns how many."""
    made = chunk_pages(spark.read.parquet(pages), IngestHooks(embed=embedded), most, overlap)
    held = Collections(spark, root)
    held.save(name, made)
    held.build_index(name)
    return held.count_lines(name)


def open_collection(spark: SparkSession, root: str, name: str):
    """A collection's chunks, the table of their vectors and their index, which were made at ingest; None where there is none."""
    held = Collections(spark, root)
    return held.load(name).withColumnRenamed("chunk_id", "doc_id"), held.vectors(name), held.index(name)


class Chat:
    """A conversation on the command line: what was said, kept within a budget."""

    def __init__(self, budget: Budget):
        self.budget, self.turns, self.session = budget, [], Session()

    def add(self, role: str, text: str) -> None:
        self.session.add(len(self.turns), text, len(TOKEN.findall(text)), self.budget)
        self.turns.append((role, text))

    def command(self, line: str) -> str | None:
        """The reply to ``history``, ``clear`` or ``state``; None for what is a question."""
        line = line.lower()
        if line == "history":
            return "\n".join(f"[{role.upper()}] {text}" for role, text in self.turns) or "nothing was said yet"
        if line == "clear":
            self.turns, self.session = [], Session()
            return "cleared"
        if line == "state":
            _, turn, cut, tokens, n, summary = self.session.row(None, self.budget)
            return f"turns={turn + 1}, kept={n}, tokens={tokens} of {self.budget.tokens}, truncated={cut}, summary={summary}"
        return None


def report(spark: SparkSession, flow: Workflow, questions, show_retrieval: bool = False, show_state: bool = False, chat: Chat | None = None) -> bool:
    """Print route, answer and each citation once for every question; whether all went well."""
    try:
        for row in flow.answer(questions).collect():
            if chat is not None:
                chat.add("assistant", row["answer"])
            print(f"[{row['route']}] {row['answer']}")
            if show_state:
                print(", ".join(f"{k}={v}" for k, v in row.asDict().items() if k not in ("answer", "route")))
        ranked = build_citations(flow.fast(questions), "query_id").select("query_id", F.col("rank").alias("pos"), F.col("source_doc").alias("doc"), F.col("page_number").alias("page"), "text")
        for row in verify.first_citations(ranked, "query_id").orderBy("query_id", "pos").collect():
            print(f"  {row['doc']}, page {row['page']}" + (f": {row['text'][:80]}" if show_retrieval else ""))
        return True
    except Exception as error:  # a question that fails doesn't end a session
        print(f"error: {error}")
        return False


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagequarry")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest")
    p.add_argument("pages")
    p.add_argument("-c", "--collection", default="default")
    p.add_argument("--root", default="collections")
    p.add_argument("--chunk-max-tokens", type=int, default=512)
    p.add_argument("--overlap", type=int, default=64)
    p = commands.add_parser("ask")
    p.add_argument("question")
    p.add_argument("-c", "--collection", default="default")
    p.add_argument("--root", default="collections")
    p.add_argument("--config-override", nargs="*", default=[])
    p.add_argument("--show-retrieval", action="store_true")
    p.add_argument("--show-state", action="store_true")
    p = commands.add_parser("chat")
    p.add_argument("-c", "--collection", default="default")
    p.add_argument("--root", default="collections")
    p.add_argument("--config-override", nargs="*", default=[])
    p = commands.add_parser("tools")
    p.add_argument("-c", "--collection")
    p.add_argument("--root", default="collections")
    given = parser.parse_args(args)
    spark = build_session()
    if given.command == "ingest":
        print(ingest(spark, given.pages, given.root, given.collection, given.chunk_max_tokens, given.overlap), "chunks")
    elif given.command in ("ask", "chat"):
        config = override(Config(), parse_overrides(given.config_override))
        chunks, vectors, index = open_collection(spark, given.root, given.collection)
        flow = Workflow(chunks, index or retrieval.build_index(chunks), Hooks(embed=embedded), config.retrieval, vectors=vectors)
        asked = lambda text: spark.createDataFrame([(0, text)], "query_id int, text string")
        if given.command == "ask":
            return 0 if report(spark, flow, asked(given.question), given.show_retrieval, given.show_state) else 1
        chat = Chat(config.memory)
        for line in map(str.strip, sys.stdin):
            if line.lower() in ("exit", "quit", "q"):
                break
            if (said := chat.command(line)) is not None:
                print(said)
            elif line:
                chat.add("user", line)
                report(spark, flow, asked(line), chat=chat)
    else:
        chunks, vectors, index = open_collection(spark, given.root, given.collection) if given.collection else (None, None, None)
        registry = build_registry(spark, chunks, index, ToolModels(embed=embedded), vectors)
        for line in sys.stdin:
            if line.strip():
                print(registry.handle(line), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
