"""The seventeen tools by name, with their schemas, called in process. Errors are replies with a code, as a server gives them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import finance, text
from pagequarry.operators import charts, retrieval, tables, verify
from pagequarry.operators.postings import PostingsIndex
from pagequarry.operators.vectors import VectorTable

INVALID_PARAMS, INTERNAL_ERROR, PARSE_ERROR, NO_METHOD = -32602, -32603, -32700, -32601


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, str]  # name -> JSON type; one that ends with "?" may be left out
    run: Callable[..., Any]

    def schema(self) -> dict[str, Any]:
        kinds = {k: {"type": v.rstrip("?")} for k, v in self.parameters.items()}
        needed = [k for k, v in self.parameters.items() if not v.endswith("?")]
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": kinds, "required": needed}}

    def schema_json(self) -> str:
        return json.dumps(self.schema(), ensure_ascii=False)


class Registry:
    def __init__(self, tools: list[Tool]):
        self.tools = {t.name: t for t in tools}

    def list(self) -> list[dict[str, Any]]:
        return [t.schema() for t in self.tools.values()]

    def call(self, name: str, **arguments) -> dict[str, Any]:
        """{"name", "result"} or {"name", "error": {"code", "message"}}."""
        tool = self.tools.get(name)
        if tool is None:
            return {"name": name, "error": {"code": INVALID_PARAMS, "message": f"Unknown tool: {name}"}}
        missing = [k for k, v in tool.parameters.items() if not v.endswith("?") and k not in arguments]
        odd = [k for k in arguments if k not in tool.parameters]
        if missing or odd:
            return {"name": name, "error": {"code": INVALID_PARAMS, "message": f"missing {missing}, unknown {odd}"}}
        try:
            return {"name": name, "result": tool.run(**arguments)}
        except Exception as error:  # a tool's failure is a reply
            return {"name": name, "error": {"code": INTERNAL_ERROR, "message": str(error)}}

    def bind(self) -> dict[str, Callable[..., Any]]:
        """name -> function that raises what ``call`` would reply."""

        def bound(name: str):
            def run(**arguments):
                reply = self.call(name, **arguments)
                if "error" in reply:
                    raise RuntimeError(reply["error"]["message"])
                return reply["result"]

            return run

        return {n: bound(n) for n in self.tools}

    def handle(self, line: str) -> str:
        """One line of a request, tools/list or tools/call, to one line of a reply."""
        try:
            request = json.loads(line)
        except ValueError as error:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(error)}})
        reply: dict[str, Any] = {"jsonrpc": "2.0", "id": request.get("id")}
        method, given = request.get("method"), request.get("params") or {}
        if method == "tools/list":
            reply["result"] = {"tools": self.list()}
        elif method == "tools/call":
            called = self.call(given.get("name", ""), **(given.get("arguments") or {}))
            reply |= {"error": called["error"]} if "error" in called else {"result": called["result"]}
        else:
            reply["error"] = {"code": NO_METHOD, "message": f"Unknown method: {method}"}
        return json.dumps(reply, ensure_ascii=False, default=str)


@dataclass(frozen=True)
class ToolModels:
    """``embed``: rows with text to rows with text and vector; ``judge`` and ``audit``: a prompt column to a reply column."""

    embed: Callable[[DataFrame], DataFrame] | None = None
    judge: verify.Model | None = None
    audit: verify.Model | None = None


def build_registry(spark: SparkSession, chunks: DataFrame | None = None, index: retrieval.Bm25Index | PostingsIndex | None = None, models: ToolModels = ToolModels(), vectors: VectorTable | None = None) -> Registry:
    """All tools. Retrieval ones read ``chunks`` (doc_id, text, source_doc, page_number, and for dense retrieval vector, or the stored
    ``vectors``); others work on their arguments. The index is built when it is first asked for, once.
    """
    held = [index]

    def frame(rows: list[tuple], schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    def one(df: DataFrame) -> dict[str, Any]:
        return df.first().asDict(recursive=True)

    def many(df: DataFrame) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in df.collect()]

    # documents
    def table_parse(table_text: str):
        rows = one(frame([(table_text,)], "md string").select(tables.parse_markdown(F.col("md"), keep_empty=True).alias("rows")))["rows"]
        return {"headers": rows[0] if rows else [], "rows": rows[1:]}

    def cross_page_merge(fragments: list):
        rows = [(0, p, i, [str(c) for c in cells]) for p, page in enumerate(fragments) for i, cells in enumerate(page)]
        return one(tables.merge_pages(frame(rows, "id int, page int, row_no int, cells array<string>"), "id").select("head", "body"))

    def chart_extract(ocr_text: str, caption: str = "", page: int = 1):
        found = charts.chunk_text(charts.extract_charts(frame([(ocr_text, caption, page)], "text string, caption string, page int")))
        return one(found.select("chart_type", "title", "caption", "description", "points", "low", "high", "unit", "chunk"))

    def ocr_correct(cell_texts: list, language: str = "mixed"):
        fixed = frame([(i, x) for i, x in enumerate(cell_texts)], "i int, x string").select("i", "x", text.correct_ocr(F.col("x"), F.lit(language)).alias("y")).orderBy("i").collect()
        return {"original_texts": cell_texts, "corrected_texts": [r["y"] for r in fixed], "num_corrected": sum(r["x"] != r["y"] for r in fixed), "language": language}

    # retrieval
    def corpus():
        if chunks is None:
            raise ValueError("no collection is loaded")
        held[0] = held[0] or retrieval.build_index(chunks)
        return chunks, held[0]

    def shown(ranked: DataFrame, score: str) -> list[dict[str, Any]]:
        rows = ranked.join(corpus()[0], "doc_id").orderBy("rank")
        return many(rows.select("doc_id", F.substring("text", 1, 300).alias("text"), "source_doc", "page_number", F.round(score, 4).alias("score"), "rank"))

    def found(asked: DataFrame, k: int, mode: str) -> tuple[DataFrame, str]:
        """Ranked chunks and the mode they were found by: without vectors or a model that makes them, a mode that needs both lists makes
        do with the sparse one."""
        texts, postings = corpus()
        if (vectors is not None or "vector" in texts.columns) and models.embed is not None:
            asked = models.embed(asked)
        elif mode in ("hybrid", "rerank"):
            mode = "sparse_only"
        elif mode == "dense_only":
            raise ValueError("the collection has no vectors, or no model makes the query's")
        settings = retrieval.Settings(final_fast=k, candidates=max(20, k), dense_k=max(15, k), sparse_k=max(15, k))
        return retrieval.retrieve(texts, asked, mode, settings=settings, index=postings, vectors=vectors), mode

    def hybrid_search(query: str, top_k: int = 6, mode: str = "hybrid"):
        ranked, used = found(frame([(0, query)], "query_id int, text string"), top_k, mode)
        return shown(ranked, "rerank_score" if used == "rerank" else "rrf")

    def rerank(query: str, documents: list, top_k: int = 5):
        pairs = frame([(0, i, query, d) for i, d in enumerate(documents)], "query_id int, doc_id int, query_text string, text string")
        return many(retrieval.rerank(pairs, top_k).orderBy("rank").select("doc_id", "rerank_score", "rank"))

    def multi_query(queries: list, top_k_per_query: int = 15, final_k: int = 10, mode: str = "hybrid"):
        asked = frame([(i, q) for i, q in enumerate(queries)], "query_id int, text string")
        ranked = found(asked, top_k_per_query, mode)[0].select("query_id", "doc_id", "rank").withColumn("g", F.lit(0))
        return shown(retrieval.fuse_queries(ranked, "g", final=final_k), "rrf")

    # analysis
    def metric_extract(tables_: list, metric: str, context_fields: list = ("year",)):
        found = tables.metric_values(frame([(i, t) for i, t in enumerate(tables_)], "t int, md string"), metric, tuple(context_fields))
        return many(found.orderBy("t", "pos"))

    def calculate(metric: str, values: dict):
        result, unit, error = finance.calculate(F.lit(metric), F.col("v"))
        return one(frame([({k: float(v) for k, v in values.items()},)], "v map<string,double>").select(F.lit(metric).alias("metric"), result.alias("result"), unit.alias("unit"), error.alias("error")))

    def unit_normalize(values: list, target_unit: str = "absolute", cjk_units: bool = False):
        rows = frame([(i, str(v)) for i, v in enumerate(values)], "i int, v string").select("i", finance.normalize_units(F.col("v"), target_unit, cjk_units).alias("n")).orderBy("i").collect()
        return {"original_values": values, "normalized_values": [r["n"] for r in rows], "target_unit": target_unit}

    def cross_table_map(table_headers: list, table_names: list | None = None):
        names = table_names or [f"Table_{i}" for i in range(len(table_headers))]
        return many(tables.field_map(frame(list(zip(names, table_headers, strict=False)), "name string, head array<string>"), "name", "head"))

    def cagr(start_value: float, end_value: float, years: float):
        if start_value <= 0 or years <= 0 or end_value < 0:
            raise ValueError("start_value and years must be positive, and end_value not negative")
        c = finance.cagr_percent(F.col("a"), F.col("b"), F.col("y"))
        return one(frame([(float(start_value), float(end_value), float(years))], "a double, b double, y double").select(c.alias("cagr_percent")))

    def yoy(current_value: float, prior_value: float, period_label: str = ""):
        if prior_value == 0:
            raise ValueError("prior_value cannot be zero")
        f = frame([(float(current_value), float(prior_value))], "a double, b double")
        return one(f.select(F.lit(period_label).alias("period"), finance.yoy_percent(F.col("a"), F.col("b")).alias("yoy_growth_percent"), F.round(F.col("a") - F.col("b"), 4).alias("absolute_change")))

    # verification
    def evidence_check(question: str, evidence_chunks: list):
        row = frame([(question, [c["text"] for c in evidence_chunks])], "q string, e array<string>")
        return one(row.select(verify.evidence_check(F.col("q"), F.col("e"), models.judge).alias("c")).select("c.*"))

    def citation_verify(answer: str, evidence_chunks: list):
        evidence = frame([(0, c["source_doc"], int(c["page_number"])) for c in evidence_chunks], "answer_id int, doc string, page int")
        return one(verify.verify_citations(frame([(0, answer)], "answer_id int, answer string"), evidence))

    def groundedness(answer: str, evidence_chunks: list, question: str = ""):
        row = frame([(question, answer, [c["text"] for c in evidence_chunks])], "q string, a string, e array<string>")
        return one(row.select(verify.answer_groundedness(F.col("q"), F.col("a"), F.col("e"), models.audit).alias("g")).select("g.*"))

    def missing_data(answer: str, evidence_chunks: list):
        numbers, years, percents, level = verify.missing_data(F.col("a"), F.col("e"))
        row = frame([(answer, " ".join(c["text"] for c in evidence_chunks))], "a string, e string")
        return one(row.select(F.slice(numbers, 1, 10).alias("missing_numbers"), years.alias("missing_years"), percents.alias("missing_percentages"), level.alias("alert_level")))

    s, n, a, o = "string", "number", "array", "object"
    return Registry([
        Tool("document_table_parse", "Header and rows of a Markdown table.", {"table_text": s}, table_parse),
        Tool("document_cross_page_merge", "One table from its fragments on several pages.", {"fragments": a}, cross_page_merge),
        Tool("document_chart_extract", "Type, title, points and description of a chart's text.", {"ocr_text": s, "caption": "string?", "page": "number?"}, chart_extract),
        Tool("document_ocr_correct", "Corrected cell texts.", {"cell_texts": a, "language": "string?"}, ocr_correct),
        Tool("retrieval_hybrid_search", "The best chunks for a query.", {"query": s, "top_k": "number?", "mode": "string?"}, hybrid_search),
        Tool("retrieval_rerank", "Documents in the order of their relevance to a query.", {"query": s, "documents": a, "top_k": "number?"}, rerank),
        Tool("retrieval_multi_query", "The best chunks for several queries together.", {"queries": a, "top_k_per_query": "number?", "final_k": "number?", "mode": "string?"}, multi_query),
        Tool("analysis_metric_extract", "Values of a metric in Markdown tables.", {"tables_": a, "metric": s, "context_fields": "array?"}, metric_extract),
        Tool("analysis_calculate", "A ratio from named values.", {"metric": s, "values": o}, calculate),
        Tool("analysis_unit_normalize", "Numbers of texts with unit suffixes.", {"values": a, "target_unit": "string?", "cjk_units": "boolean?"}, unit_normalize),
        Tool("analysis_cross_table_map", "Which headers of several tables mean the same field.", {"table_headers": a, "table_names": "array?"}, cross_table_map),
        Tool("analysis_cagr", "Compound annual growth rate.", {"start_value": n, "end_value": n, "years": n}, cagr),
        Tool("analysis_yoy_growth", "Growth over the year before.", {"current_value": n, "prior_value": n, "period_label": "string?"}, yoy),
        Tool("verification_evidence_check", "Whether evidence suffices for a question.", {"question": s, "evidence_chunks": a}, evidence_check),
        Tool("verification_citation_backtrack", "Whether citations point to the evidence.", {"answer": s, "evidence_chunks": a}, citation_verify),
        Tool("verification_groundedness", "Whether claims are supported; needs a model.", {"answer": s, "evidence_chunks": a, "question": "string?"}, groundedness),
        Tool("verification_missing_data", "Numbers and years of an answer that its evidence lacks.", {"answer": s, "evidence_chunks": a}, missing_data),
    ])
