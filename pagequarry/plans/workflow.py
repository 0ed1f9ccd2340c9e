"""Question answering over a collection for many questions at once.

A question's route splits the plan: the fast one retrieves and reranks once, the slow one plans queries, retrieves for each,
fuses and reranks, then verifies its citations. Models are hooks: functions from columns to a column, or chats whose replies are
remembered (``plans.models``). The defaults need no model and are stand-ins: routing by words, generation by extraction. Where a chat
fails, the question goes on as if there were none, and says so in its ``errors``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import augment_query, json_in_text
from pagequarry.operators import retrieval as r
from pagequarry.operators import verify
from pagequarry.operators.postings import PostingsIndex
from pagequarry.operators.vectors import VectorTable
from pagequarry.plans.models import Remembered
from pagequarry.sources.shared import shared_path

SLOW_WORDS = ["compare", "trend", "growth", "analyze", "analyse", "calculate", "drove", "across", "versus", " vs ", "risk", "why"]
TASK_TYPES = ["factual_query", "comparative", "trend", "risk", "financial_calc", "cross_table", "unknown"]
STRATEGIES = ["text", "table", "figure", "all"]


def route_words(question: Column) -> Column:
    """The offline router's reply, in the form that a model gives."""
    low, slow = F.lower(question), F.lit(False)
    for w in SLOW_WORDS:
        slow = slow | low.contains(w)
    return F.when(slow, '{"route": "slow", "confidence": 0.5}').otherwise('{"route": "fast", "confidence": 0.5}')


def parse_route(reply: Column) -> tuple[Column, Column]:
    """(route, confidence) of a router's reply; what can't be read is slow."""
    parsed = F.from_json(json_in_text(reply), "route string, confidence double")
    return F.when(parsed["route"].isin("fast", "slow"), parsed["route"]).otherwise("slow"), F.coalesce(parsed["confidence"], F.lit(0.0))


def parse_task_type(reply: Column) -> Column:
    name = F.lower(F.trim(reply))
    return F.when(name.isin(TASK_TYPES), name).otherwise("unknown")


def parse_subtasks(reply: Column) -> Column:
    """array<struct<task_id, description, strategy, key_terms>>; a reply that isn't a list has none."""
    kind = "array<struct<task_id:string,description:string,strategy:string,key_terms:array<string>>>"
    trimmed = F.trim(reply)
    return F.coalesce(F.when(trimmed.startswith("["), F.from_json(trimmed, kind)), F.array().cast(kind))


def dominant_strategy(subtasks: DataFrame, key: str) -> DataFrame:
    """(key, strategy): the most frequent strategy but "all", the one seen first among equals; "all" where there is no other."""
    counts = subtasks.groupBy(key, "strategy").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    other = F.col("strategy") != "all"
    return counts.groupBy(key).agg(F.coalesce(F.max_by("strategy", F.when(other, F.struct("n", -F.col("first")))), F.lit("all")).alias("strategy"))


def plan_queries(subtasks: DataFrame, key: str) -> DataFrame:
    """(key, pos, query): a query for each sub-task, its key terms added."""
    return subtasks.select(key, "pos", augment_query(F.col("description"), F.col("key_terms")).alias("query"))


def extract_answer(text: Column, doc: Column, page: Column) -> Column:
    """The offline generator: the best chunk's beginning, with its citation."""
    return F.concat(F.substring(text, 1, 200), F.lit(" [Source: "), doc, F.lit(", page "), page.cast("string"), F.lit("]"))


def extract_best(question: Column, evidence: Column) -> Column:
    """The offline generator over all evidence: what ``extract_answer`` makes of the best chunk."""
    best = F.get(evidence, F.lit(0))
    return extract_answer(best["text"], best["source_doc"], best["page_number"])


#: What chats are asked; each prompt ends with the question.
ROUTE_PROMPT = 'Does this question need one look-up (fast), or several documents, comparison or calculation (slow)? Reply with {"route": "fast" or "slow", "confidence": 0 to 1}.\n\n'
TASK_PROMPT = f"Of which kind is this question? Reply with one of: {', '.join(TASK_TYPES)}.\n\n"
PLAN_PROMPT = (
    "Split this question into tasks that can be looked up by themselves. Reply with a JSON array of objects with task_id, description, "
    f"strategy (one of {', '.join(STRATEGIES)}) and key_terms.\n\n"
)
ANSWER_PROMPT = "Answer from the evidence alone, and cite it as [Source: document, page number].\n\n"


def evidence_block(evidence: Column) -> Column:
    """The evidence as a prompt has it."""
    line = lambda e: F.concat(F.lit("[Source: "), e["source_doc"], F.lit(", page "), e["page_number"].cast("string"), F.lit("]\n"), e["text"])
    return F.array_join(F.transform(evidence, line), "\n\n")


def build_citations(ranked: DataFrame, key: str) -> DataFrame:
    """(key, rank, source_doc, page_number, text): the chunks behind an answer, each text cut to 200 characters."""
    return ranked.select(key, "rank", "source_doc", "page_number", F.substring("text", 1, 200).alias("text"))


@dataclass(frozen=True)
class Hooks:
    """``generate``: a question and its evidence, an array of (rank, text, source_doc, page_number) in order, to an answer. A chat takes
    the place of the column that it names: ``router``, ``typer`` (the task's type), ``planner`` (sub-tasks), ``writer`` (answers)."""

    route: Callable[[Column], Column] = route_words
    score: Callable[[Column, Column], Column] = r.overlap_score
    generate: Callable[[Column, Column], Column] = extract_best
    embed: Callable[[DataFrame], DataFrame] | None = None  # rows with text to rows with text and vector
    router: Remembered | None = None
    typer: Remembered | None = None
    planner: Remembered | None = None
    writer: Remembered | None = None


def _failed(node: str) -> Column:
    """The errors so far, and the one that a chat has just left."""
    return F.when(F.col("error").isNotNull(), F.map_concat("errors", F.create_map(F.lit(node), F.col("error")))).otherwise(F.col("errors"))


@dataclass(frozen=True)
class Workflow:
    """Chunks have doc_id, text, source_doc and page_number, and a vector where dense retrieval shall find them, unless ``vectors`` is their
    stored table.

    The index is built once and written. Questions may bring a ``vector``; where they don't, ``hooks.embed`` gives them one if it is
    set. A question without a vector is answered by the sparse list alone. ``mode`` is one of ``retrieval.retrieve``.
    """

    chunks: DataFrame
    index: r.Bm25Index | PostingsIndex
    hooks: Hooks = field(default_factory=Hooks)
    settings: r.Settings = field(default_factory=r.Settings)
    mode: str = "hybrid"
    vectors: VectorTable | None = None

    def route(self, questions: DataFrame) -> DataFrame:
        """``questions`` with route, confidence, task_type and errors (a map from nodes to what went wrong in them)."""
        rows = questions.withColumn("errors", F.create_map().cast("map<string,string>"))
        reply = self.hooks.route(F.col("text"))
        if self.hooks.router is not None:
            rows = self.hooks.router.ask(rows, F.concat(F.lit(ROUTE_PROMPT), "text")).withColumn("errors", _failed("router"))
            reply = F.col("reply")
        route, confidence = parse_route(reply)
        rows = rows.withColumns({"route": route, "confidence": confidence}).drop("reply", "error")
        if self.hooks.typer is None:
            return rows.withColumn("task_type", F.lit("unknown"))
        typed = self.hooks.typer.ask(rows, F.concat(F.lit(TASK_PROMPT), "text")).withColumn("errors", _failed("task_type"))
        return typed.withColumn("task_type", F.coalesce(parse_task_type(F.col("reply")), F.lit("unknown"))).drop("reply", "error")

    def decompose(self, questions: DataFrame) -> DataFrame:
        """``questions`` with sub_tasks: those of the planner's reply; the question itself where there is no planner, it fails, or lists none."""
        kind = "array<struct<task_id:string,description:string,strategy:string,key_terms:array<string>>>"
        own = F.array(F.struct(F.lit("t0").alias("task_id"), F.col("text").alias("description"), F.lit("all").alias("strategy"), F.array().cast("array<string>").alias("key_terms"))).cast(kind)
        if self.hooks.planner is None:
            return questions.withColumn("sub_tasks", own)
        planned = self.hooks.planner.ask(questions, F.concat(F.lit(PLAN_PROMPT), "text")).withColumn("errors", _failed("task_decomposition"))
        known = F.transform(
            F.filter(parse_subtasks(F.col("reply")), lambda t: t["description"].isNotNull()),
            lambda t: F.struct(t["task_id"].alias("task_id"), t["description"].alias("description"), F.when(t["strategy"].isin(STRATEGIES), t["strategy"]).otherwise("all").alias("strategy"), F.coalesce(t["key_terms"], F.array().cast("array<string>")).alias("key_terms")),
        )
        return planned.withColumn("sub_tasks", F.when(F.size(known) > 0, known.cast(kind)).otherwise(own)).drop("reply", "error")

    def _found(self, queries: DataFrame, route: str) -> DataFrame:
        """Ranked chunks of queries (query_id, text, vector or none)."""
        if self.hooks.embed is not None and "vector" not in queries.columns:
            queries = self.hooks.embed(queries)
        dense = "vector" in queries.columns and (self.vectors is not None or "vector" in self.chunks.columns)
        ranked = r.retrieve(self.chunks, queries, self.mode if dense else "sparse_only", route, self.settings, self.index, self.vectors)
        return ranked.select("query_id", "doc_id", "rank")

    def _texts(self, ranked: DataFrame, questions: DataFrame) -> DataFrame:
        return ranked.join(self.chunks.select("doc_id", "text", "source_doc", "page_number"), "doc_id").join(questions.select("query_id", F.col("text").alias("query_text")), "query_id")

    def fast(self, questions: DataFrame) -> DataFrame:
        """Reranked chunks of each question, without a threshold."""
        found = self._found(questions, "fast")
        return r.rerank(self._texts(found, questions), self.settings.final_fast, scorer=self.hooks.score)

    def slow(self, questions: DataFrame, subtasks: DataFrame) -> DataFrame:
        """Reranked chunks of each question, over the queries of its sub-tasks (query_id, pos, description, strategy, key_terms)."""
        number = F.concat_ws("/", F.col("query_id").cast("string"), F.col("pos").cast("string"))
        planned = plan_queries(subtasks, "query_id").select(number.alias("query_id"), F.col("query_id").alias("question_id"), F.col("query").alias("text"))
        if self.hooks.embed is None and "vector" in questions.columns:  # a sub-task's query takes its question's vector
            planned = planned.join(questions.select(F.col("query_id").alias("question_id"), "vector"), "question_id", "left")
        found = self._found(planned, "slow").join(planned.select("query_id", "question_id"), "query_id")
        fused = r.fuse_queries(found, "question_id", self.settings.rrf_k, self.settings.final_slow).withColumnRenamed("question_id", "query_id")
        return r.rerank(self._texts(fused, questions), self.settings.final_slow, scorer=self.hooks.score)

    def generate(self, questions: DataFrame, ranked: DataFrame) -> DataFrame:
        """``questions`` with evidence, the reranked chunks in order, and answer, which is empty without evidence or where the writer fails."""
        part = F.struct("rank", "text", "source_doc", F.col("page_number").cast("long").alias("page_number"))
        rows = questions.join(ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("evidence")), "query_id", "left")
        said = self.hooks.generate(F.col("text"), F.col("evidence"))
        if self.hooks.writer is not None:
            prompt = F.concat(F.lit(ANSWER_PROMPT), evidence_block(F.col("evidence")), F.lit("\n\nQuestion: "), "text")
            rows = self.hooks.writer.ask(rows, prompt).withColumn("errors", _failed("generation"))
            said = F.col("reply")
        return rows.withColumn("answer", F.when(F.col("evidence").isNotNull(), F.coalesce(said, F.lit(""))).otherwise("")).drop("reply", "error")

    def answer(self, questions: DataFrame, subtasks: DataFrame | None = None) -> DataFrame:
        """(query_id, route, task_type, strategy, answer, n_found, n_valid, verified, groundedness, errors) of questions (query_id, text).

        ``strategy`` is that of most sub-tasks, "all" on the fast route. What is routed, retrieved and answered is written once each to the
        shared folder and read by the nodes after it.
        """
        held = _Held(questions.sparkSession)
        routed = held.keep(self.route(questions), "routed")
        slow = routed.where("route = 'slow'")
        if subtasks is None:
            slow = held.keep(self.decompose(slow), "planned")
            subtasks = slow.select("query_id", F.posexplode("sub_tasks").alias("pos", "t")).select("query_id", "pos", "t.description", "t.strategy", "t.key_terms")
            slow = slow.drop("sub_tasks")
        ranked = self.fast(routed.where("route = 'fast'")).unionByName(self.slow(slow, subtasks), allowMissingColumns=True)
        ranked = held.keep(ranked.select("query_id", "rank", "text", "source_doc", "page_number"), "ranked")
        strategy = dominant_strategy(subtasks, "query_id")
        both = routed.where("route <> 'slow'").unionByName(slow).join(strategy, "query_id", "left").withColumn("strategy", F.coalesce("strategy", F.lit("all")))
        answers = held.keep(self.generate(both, ranked).drop("evidence"), "answers")
        evidence = ranked.select("query_id", F.col("source_doc").alias("doc"), F.col("page_number").alias("page"))
        checked = verify.verify_citations(answers, evidence, "query_id").drop("issues")
        return answers.select("query_id", "route", "task_type", "strategy", "answer", "errors").join(checked, "query_id")


class _Held:
    """Tables of one call under the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_path(spark, "workflow")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
