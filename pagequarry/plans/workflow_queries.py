"""Queries of collections and of the question-answering workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import retrieval as r
from pagequarry.plans import workflow as w
from pagequarry.plans.catalog import COLLECTION_SQL, collection, query, table
from pagequarry.plans.retrieval_queries import _FUSED, _JOINT, _terms_of, asked, docs_of, joint, vectors_of
from pagequarry.sources import collections as c
from pagequarry.sources.shared import shared_path

# --- collections -----------------------------------------------------------------------------------------------------


def _saved(spark: SparkSession, sf_dir: str, parquet: bool = False) -> c.Collections:
    held = c.Collections(spark, shared_path(spark, "collections"), parquet)
    chunks = collection(spark, sf_dir).withColumn("embedding", F.array(F.lit(1.0))).withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("metadata", F.create_map(F.lit("k"), F.col("source_doc")))
    held.save("reports", chunks, ingested_at="2024-01-01T00:00:00")
    return held


@query(f"WITH {COLLECTION_SQL} SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, text, source_doc, page_number, token_count, chunk_type FROM (SELECT * REPLACE (CAST(token_count AS BIGINT) AS token_count) FROM collection)")
def collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).load("reports").select("chunk_id", "text", "source_doc", "page_number", "token_count", "chunk_type")


@query(f"WITH {COLLECTION_SQL} SELECT CAST(count(*) AS BIGINT) AS n_lines, 0::BIGINT AS n_missing FROM collection")
def collection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _saved(spark, sf_dir)
    return spark.range(1).select(F.lit(held.count_lines("reports")).cast("long").alias("n_lines"), F.lit(held.count_lines("nothing")).cast("long").alias("n_missing"))


@query(f"WITH {COLLECTION_SQL} SELECT chunk_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, '2024-01-01T00:00:00' AS ingested_at FROM collection GROUP BY 1")
def collection_save_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved as Parquet, partitioned by chunk type, and read again; the vectors stay out."""
    rows = _saved(spark, sf_dir, parquet=True).load("reports")
    return rows.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.date_format(F.max("ingested_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("ingested_at"))


@query(f"WITH {COLLECTION_SQL} SELECT chunk_type, CAST(count(*) AS BIGINT) AS n FROM collection GROUP BY 1")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir).groupBy("chunk_type").agg(F.count("*").alias("n"))


@query(f"WITH {COLLECTION_SQL} SELECT chunk_id, chunk_type, CASE WHEN chunk_type = 'table' THEN source_doc END AS table_name, CASE WHEN chunk_type = 'chart' THEN 'bar' END AS chart_type FROM collection")
def collection_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collection(spark, sf_dir).select("chunk_id", "chunk_type", "source_doc")
    of = lambda k: rows.where(F.col("chunk_type") == k)
    whole = c.union_chunks(of("text"), of("table").withColumn("table_name", F.col("source_doc")), of("chart").withColumn("chart_type", F.lit("bar")))
    return whole.select("chunk_id", "chunk_type", "table_name", "chart_type")


@query("WITH p AS (SELECT '/in/' || regexp_replace(url, '[?#].*$', '') || '.pdf' AS path, page_id AS ord FROM pages UNION ALL SELECT '/in/' || regexp_replace(url, '[?#].*$', '') || '.pdf', page_id + 1000000 FROM pages) SELECT path, CAST(min(ord) AS BIGINT) AS ord FROM p GROUP BY 1")
def dedup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/"), F.regexp_replace("url", "[?#].*$", ""), F.lit(".pdf")).alias("path"), F.col("page_id").alias("ord"))
    return c.first_of_each(pages.union(pages.select("path", F.col("ord") + 1_000_000)), ["path"], ["ord"])


@query("SELECT item_id AS line, 'answer ' || item_id AS answer, CAST(1 + item_id % 3 AS INTEGER) AS n_contexts FROM benchmark")
def eval_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"), F.array_repeat("text", (1 + F.col("item_id") % 3).cast("int")).alias("contexts"))
    path = shared_path(spark, "evaluation")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path).select("line", "answer", F.size("contexts").alias("n_contexts"))


@query("SELECT a.item_id AS line, len(a.text) AS n_answer, len(d.text) AS n_context, d.source AS question FROM benchmark a JOIN documents d ON d.doc_id = a.item_id")
def eval_align_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, contexts and questions by their line; the shortest input ends them all."""
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line"), F.length("text").cast("long").alias("n_answer"))
    docs = table(spark, sf_dir, "documents")
    contexts = docs.select(F.col("doc_id").alias("line"), F.length("text").cast("long").alias("n_context"))
    questions = docs.select(F.col("doc_id").alias("line"), F.col("source").alias("question"))
    return c.align_by_position(answers, contexts, questions)


#: Lines of a part of an evaluation file, so that no task's share grows with the input.
_LINES_A_PART = 10_000


@query(
    "WITH a AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS line FROM benchmark), d AS (SELECT text, source, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents) "
    "SELECT line, a.text AS answer, d.text AS context, d.source AS question FROM a JOIN d USING (line)"
)
def eval_align_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation files without ids, in several parts each, zipped by the positions of their lines."""
    base, docs = shared_path(spark, "evaluation"), table(spark, sf_dir, "documents")
    table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.col("text").alias("answer")).write.json(f"{base}/answers")
    parts = docs.count() // _LINES_A_PART
    docs.repartitionByRange(max(5, parts), "doc_id").sortWithinPartitions("doc_id").select(F.array("text").alias("contexts")).write.json(f"{base}/contexts")
    docs.repartitionByRange(max(3, parts), "doc_id").sortWithinPartitions("doc_id").select(F.col("source").alias("question")).write.json(f"{base}/questions")
    rows = c.align_files(spark, f"{base}/answers", f"{base}/contexts", f"{base}/questions")
    return rows.select("line", "answer", F.get("contexts", F.lit(0)).alias("context"), "question")


# --- workflow --------------------------------------------------------------------------------------------------------

_ASKS = ["What was the revenue in FY2024?", "Compare growth over 3 years", "Analyze risk factors", "What is the current P/E ratio?"]
_ASK_SQL = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(_ASKS)) + " END"
_SLOW = " OR ".join(f"contains(lower(q), '{x}')" for x in w.SLOW_WORDS)
_REPLY_SQL = """CASE doc_id % 6 WHEN 4 THEN 'no json' WHEN 5 THEN '{"route": "sideways", "confidence": 0.75}' ELSE CASE WHEN {slow} THEN '{"route": "slow", "confidence": 0.5}' ELSE '{"route": "fast", "confidence": 0.5}' END END""".replace("{slow}", _SLOW)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    asked_ = F.element_at(F.array(*map(F.lit, _ASKS)), (n % 4 + 1).cast("int"))
    reply = F.when(n % 6 == 4, "no json").when(n % 6 == 5, '{"route": "sideways", "confidence": 0.75}').otherwise(w.route_words(asked_))
    route, confidence = w.parse_route(reply)
    return table(spark, sf_dir, "documents").select("doc_id", route.alias("route"), confidence.alias("confidence"))


@query(f"""WITH q AS (SELECT doc_id, {_ASK_SQL} AS q FROM documents), p AS (SELECT doc_id, {_REPLY_SQL} AS reply FROM q)
SELECT doc_id, CASE WHEN contains(reply, '"fast"') THEN 'fast' ELSE 'slow' END AS route, CASE WHEN reply = 'no json' THEN 0.0::DOUBLE WHEN contains(reply, '0.75') THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM p""")
def route_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir)


@query(f"""WITH q AS (SELECT doc_id, {_ASK_SQL} AS q FROM documents), p AS (SELECT doc_id, {_REPLY_SQL} AS reply FROM q)
SELECT CASE WHEN contains(reply, '"fast"') THEN 'fast' ELSE 'slow' END AS route, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1""")
def route_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _questions(spark, sf_dir)
    return routed.where("route = 'fast'").unionByName(routed.where("route = 'slow'")).groupBy("route").agg(F.count("*").alias("n"))


def _subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-tasks that replies about each document list, one reply in five being no list."""
    n = F.col("doc_id")
    s = lambda x: x.cast("string")
    strategy = lambda i: F.element_at(F.array(*map(F.lit, w.STRATEGIES)), ((n + i) % 4 + 1).cast("int"))
    task = lambda i: F.concat(F.lit(f'{{"task_id": "t{i}", "description": "part {i} of '), s(n), F.lit('", "strategy": "'), strategy(i * 2), F.lit('", "key_terms": '), F.when((n + i) % 3 == 0, '["ROE", "FY2024"]').otherwise("[]"), F.lit("}"))
    reply = F.when(n % 5 == 4, "I can't").otherwise(F.concat(F.lit(" ["), task(0), F.lit(", "), task(1), F.lit(", "), task(2), F.lit("]")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(w.parse_subtasks(reply)).alias("pos", "t")).select("doc_id", "pos", "t.*")


_TASKS = "tk AS (SELECT doc_id, i AS pos, 't' || i AS task_id, 'part ' || i || ' of ' || doc_id AS description, ['text', 'table', 'figure', 'all'][1 + (doc_id + i * 2) % 4] AS strategy, CASE WHEN (doc_id + i) % 3 = 0 THEN ['ROE', 'FY2024'] ELSE [] END AS key_terms FROM documents, range(0, 3) g(i) WHERE doc_id % 5 <> 4)"


@query(f"WITH {_TASKS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, task_id, description, strategy, array_to_string(key_terms, '|') AS key_terms FROM tk")
def subtask_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subtasks(spark, sf_dir).withColumn("key_terms", F.array_join("key_terms", "|"))


@query(f"WITH {_TASKS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, description || CASE WHEN len(key_terms) > 0 THEN ' (' || array_to_string(key_terms, ', ') || ')' ELSE '' END AS query FROM tk")
def plan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.plan_queries(_subtasks(spark, sf_dir), "doc_id")


@query(f"WITH {_TASKS}, n AS (SELECT doc_id, strategy, count(*) AS n, min(pos) AS f FROM tk WHERE strategy <> 'all' GROUP BY 1, 2), b AS (SELECT doc_id, strategy, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM n) "
       "SELECT d.doc_id, coalesce(b.strategy, 'all') AS strategy FROM (SELECT DISTINCT doc_id FROM tk) d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1")  # fmt: skip
def plan_dominant_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.dominant_strategy(_subtasks(spark, sf_dir), "doc_id")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts that the workflow's queries ask with."""
    questions = asked(spark, sf_dir)
    return questions.union(questions.select("query_id", F.concat(F.lit("the "), F.substring("text", 1, 30), F.lit(" (FY2024)"))))


def _workflow(spark: SparkSession, sf_dir: str) -> w.Workflow:
    chunks = collection(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id").join(vectors_of(spark, sf_dir), "doc_id", "left")
    return w.Workflow(chunks, r.build_index(docs_of(spark, sf_dir), queries=_probes(spark, sf_dir)))


def _questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joint(spark, sf_dir)[1]


_RERANK = """
cd AS (SELECT p.query_id, p.doc_id, coalesce(d.text, '') AS text, d.source, 1 + d.doc_id % 50 AS page, b.text AS qt FROM {pool} p JOIN documents d ON d.doc_id = p.doc_id JOIN benchmark b ON b.item_id = p.query_id),
cs AS (SELECT *, list_distinct({x}) AS x, list_distinct({y}) AS y FROM cd),
cj AS (SELECT *, coalesce(round(CAST(len(list_intersect(x, y)) AS DOUBLE) / nullif(len(list_distinct(list_concat(x, y))), 0), 9), 0.0) AS j FROM cs),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, doc_id) AS rank FROM cj)
""".replace("{x}", _terms_of("coalesce(text, '')")).replace("{y}", _terms_of("coalesce(qt, '')"))
_FASTP = f"{_JOINT}, {_FUSED.format(a='jd', b='bmk')}, fp AS (SELECT * FROM fr WHERE rank <= 6), {_RERANK.replace('{pool}', 'fp')}"


@query(f"WITH {_FASTP} SELECT query_id, doc_id, round(j, 4) AS rerank_score, CAST(rank AS INTEGER) AS rank FROM cr")
def fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workflow(spark, sf_dir).fast(_questions_of(spark, sf_dir)).select("query_id", "doc_id", F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query(f"WITH {_FASTP} SELECT query_id, CAST(rank AS INTEGER) AS rank, source AS source_doc, page AS page_number, substr(text, 1, 200) AS text FROM cr")
def citation_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.build_citations(_workflow(spark, sf_dir).fast(_questions_of(spark, sf_dir)), "query_id")


_SLOWP = f"""{_JOINT.replace("item_id AS query_id, unnest(", "item_id * 2 + h AS query_id, unnest(").replace("FROM benchmark) GROUP BY ALL", "FROM (SELECT item_id, h, CASE h WHEN 0 THEN text ELSE source_text END AS text FROM (SELECT item_id, text, 'the ' || substr(text, 1, 30) || ' (FY2024)' AS source_text FROM benchmark), range(0, 2) g(h))) GROUP BY ALL")},
jh AS (SELECT * REPLACE (query_id * 2 + h AS query_id) FROM jd, range(0, 2) g(h)), {_FUSED.format(a='jh', b='bmk')},
m AS (SELECT query_id // 2 AS query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min((query_id, rank)) AS f FROM fr WHERE rank <= 8 GROUP BY 1, 2),
sp AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f) AS k FROM m QUALIFY k <= 8),
{_RERANK.replace('{pool}', 'sp')}"""


@query(f"WITH {_SLOWP} SELECT query_id, doc_id, round(j, 4) AS rerank_score, CAST(rank AS INTEGER) AS rank FROM cr")
def slow_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sub-tasks for each question: itself, and its beginning with a key term."""
    questions = _questions_of(spark, sf_dir)
    terms = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    second = F.concat(F.lit("the "), F.substring("text", 1, 30))
    tasks = questions.select("query_id", F.lit(0).alias("pos"), F.col("text").alias("description"), F.lit("all").alias("strategy"), terms().alias("key_terms")).union(questions.select("query_id", F.lit(1), second, F.lit("text"), terms("FY2024")))
    return _workflow(spark, sf_dir).slow(questions, tasks).select("query_id", "doc_id", F.round("rerank_score", 4).alias("rerank_score"), "rank")


_ANSWERED = f"""{_JOINT}, {_FUSED.format(a='jd', b='bmk')},
rt AS (SELECT item_id AS query_id, CASE WHEN {_SLOW.replace("lower(q)", "lower(text)")} THEN 'slow' ELSE 'fast' END AS route FROM benchmark),
pool AS (SELECT fr.query_id, doc_id FROM fr JOIN rt ON rt.query_id = fr.query_id WHERE fr.rank <= CASE WHEN route = 'slow' THEN 8 ELSE 6 END), {_RERANK.replace('{pool}', 'pool')},
sd AS (SELECT query_id, substr(text, 1, 200) || ' [Source: ' || source || ', page ' || page || ']' AS answer FROM cr WHERE rank = 1)"""


@query(f"WITH {_ANSWERED} SELECT rt.query_id, route, 'unknown' AS task_type, 'all' AS strategy, coalesce(answer, '') AS answer, CASE WHEN answer IS NULL THEN 0 ELSE 1 END AS n_found, "
       "CASE WHEN answer IS NOT NULL THEN 1::BIGINT END AS n_valid, true AS verified, CASE WHEN answer IS NOT NULL THEN 1.0::DOUBLE END AS groundedness, 0 AS n_errors FROM rt LEFT JOIN sd ON sd.query_id = rt.query_id")  # fmt: skip
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole workflow over the benchmark's items, with the generator that extracts."""
    answered = _workflow(spark, sf_dir).answer(_questions_of(spark, sf_dir))
    return answered.withColumns({"n_errors": F.size("errors"), "n_found": F.col("n_found").cast("int")}).drop("errors")


@query()
def answer_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole workflow over the benchmark's items; ``answer_questions`` has its SQL."""
    return _workflow(spark, sf_dir).answer(_questions_of(spark, sf_dir)).drop("errors")
