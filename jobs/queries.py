"""The jobs as registered queries: each runs twice into one new folder, and returns the whole output after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import chunk_documents, ratio_report
from pagequarry.plans.catalog import STATEMENTS_SQL
from pagequarry.plans.chunk_queries import TOKENS_SQL, chunks_sql
from pagequarry.plans.text_queries import RATIO_SQL
from pagequarry.sources.shared import shared_path


def job1_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_path(spark, "job1")
    settings = chunk_documents.Settings(documents=f"{sf_dir}/documents.parquet", output=f"{base}/output", checkpoint=f"{base}/checkpoint")
    for _ in range(2):
        chunk_documents.run(spark, settings)
    return chunk_documents.current_chunks(spark, settings.output)


def job2_ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = ratio_report.Settings(tables=sf_dir, output=shared_path(spark, "job2"))
    for _ in range(2):
        ratio_report.run(spark, settings)
    return ratio_report.written(spark, settings.output)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_chunk_documents, job2_ratio_report)}

_SETTINGS = chunk_documents.Settings("", "", "")
_DOCUMENTS = "headed AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"
JOB1_SQL = f"""
WITH {chunks_sql(_DOCUMENTS, _SETTINGS.most_tokens)},
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, f) - 1 AS INTEGER) AS chunk_index FROM ch)
SELECT doc_id, substr(sha256(doc_id || '/' || chunk_index), 1, 16) AS chunk_id, source AS source_doc, chunk_index, n.text, level AS heading_level, array_to_string(path, ' > ') AS path,
       CAST(nb AS INTEGER) AS num_blocks, coalesce(tc, {TOKENS_SQL.format("n.text")}) AS token_count, coalesce(nullif(source, ''), 'unknown') AS source
FROM n JOIN headed USING (doc_id)
"""

_LONG = " UNION ALL ".join(f"SELECT company, fy, '{m}' AS metric, round({RATIO_SQL[m]}, 4) AS value FROM statements" for m in ratio_report.METRICS)
JOB2_SQL = f"""
WITH {STATEMENTS_SQL}, long AS ({_LONG}),
grown AS (SELECT *, CASE WHEN lag(fy) OVER w = fy - 1 THEN lag(value) OVER w END AS prior_value FROM long WINDOW w AS (PARTITION BY company, metric ORDER BY fy))
SELECT company, metric, value, CASE WHEN value IS NULL THEN NULL WHEN metric LIKE '%margin%' OR metric LIKE '%growth%' OR metric LIKE '%coverage%' THEN '%' ELSE '' END AS unit,
       CASE WHEN value IS NULL THEN 'not computable' END AS error, prior_value, round((value - prior_value) / nullif(prior_value, 0) * 100, 4) AS growth_percent,
       CASE WHEN value IS NOT NULL THEN CAST(rank() OVER (PARTITION BY fy, metric ORDER BY value DESC NULLS LAST) AS INTEGER) END AS rank,
       count(value) OVER (PARTITION BY fy, metric) AS n_companies, CAST(fy AS INTEGER) AS fy
FROM grown
"""

ORACLES: dict[str, str] = {"job1_chunk_documents": JOB1_SQL, "job2_ratio_report": JOB2_SQL}
