"""Registration of queries, and the inputs that several queries derive from the tables, in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived inputs --------------------------------------------------------------------------------------------------

#: One statement per nation and year; amounts are decimals first, so that both engines have the same doubles.


def _share(x: str) -> str:
    return f"CAST(round(rev * CAST({x} AS DECIMAL(3, 2)), 2) AS DOUBLE)"


_SHARES = {
    "cogs": "0.6", "gross_profit": "0.4", "operating_income": "0.25", "net_income": "0.18", "total_assets": "2", "current_assets": "0.7", "inventory": "0.2", "total_liabilities": "1.1",
    "current_liabilities": "0.5", "shareholders_equity": "0.9", "ebitda": "0.3", "market_cap": "5", "enterprise_value": "6",
}
STATEMENTS_SQL = f"""
statements AS (
  SELECT company, fy, CAST(rev AS DOUBLE) AS revenue, CAST(interest AS DOUBLE) AS interest_expense, {", ".join(f"{_share(x)} AS {n}" for n, x in _SHARES.items())}
  FROM (SELECT n_name AS company, year(o_orderdate) AS fy, round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS rev,
               round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_tax AS DECIMAL(4, 2))), 2) AS interest
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
        GROUP BY n_name, year(o_orderdate)) s)
"""


def statements(spark: SparkSession, sf_dir: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """(company, fy, revenue, ...) from the star schema, as the SQL above; of these fiscal years only, by a filter that reaches the scan."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders")
    if first_year is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(f"{first_year}-01-01").cast("timestamp"))
    if last_year is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(f"{last_year + 1}-01-01").cast("timestamp"))
    orders = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fy"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("company"))
    price, part = F.col("l_extendedprice").cast("decimal(12,2)"), lambda c: F.col(c).cast("decimal(4,2)")
    rows = (
        line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("company", "fy")
        .agg(F.round(F.sum(price * (1 - part("l_discount"))), 2).alias("rev"), F.round(F.sum(price * part("l_tax")), 2).alias("interest"))
    )
    share = lambda x: F.round(F.col("rev") * F.lit(x).cast("decimal(3,2)"), 2).cast("double")
    return rows.select("company", "fy", F.col("rev").cast("double").alias("revenue"), F.col("interest").cast("double").alias("interest_expense"), *(share(x).alias(n) for n, x in _SHARES.items()))


#: A Markdown table per company, one row a year; amounts are cents as integers over 100.
MD_TABLES_SQL = """
md AS (
  SELECT company, '| Year | Total Revenue | Net Income |  | Current Assets |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) ||
         string_agg('| FY' || fy || ' | ' || CAST(CAST(revenue AS DECIMAL(18, 2)) AS VARCHAR) || 'B | ' || CAST(CAST(net_income AS DECIMAL(18, 2)) AS VARCHAR) || ' |  | ' ||
           CAST(CAST(current_assets AS DECIMAL(18, 2)) AS VARCHAR) || ' USD |', chr(10) ORDER BY fy) AS md
  FROM statements GROUP BY company)
"""


def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, md)"""
    cents = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    row = F.concat(F.lit("| FY"), F.col("fy").cast("string"), F.lit(" | "), cents("revenue"), F.lit("B | "), cents("net_income"), F.lit(" |  | "), cents("current_assets"), F.lit(" USD |"))
    head = "| Year | Total Revenue | Net Income |  | Current Assets |\n| --- | --- | --- | --- | --- |\n"
    rows = statements(spark, sf_dir).select("company", "fy", row.alias("row")).groupBy("company").agg(F.array_sort(F.collect_list(F.struct("fy", "row"))).alias("rows"))
    return rows.select("company", F.concat(F.lit(head), F.array_join("rows.row", "\n")).alias("md"))


ANSWERS_SQL = """
answers AS (
  SELECT doc_id, substr(text, 1, 40) || ' [Source: ' || source || ', page ' || (1 + doc_id % 7) || '] in 2024 it was ' || (doc_id % 900) || '.5, up ' || (doc_id % 13) || '% [Source: ghost , page 3]' AS answer,
         text || ' 2023 total ' || (doc_id % 700) || '.5' AS evidence, source, 1 + doc_id % 7 AS page
  FROM documents WHERE text IS NOT NULL)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, answer, evidence, source, page): an answer for each document, citing it and a source that isn't there."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    s = lambda c: c.cast("string")
    page = 1 + F.col("doc_id") % 7
    answer = F.concat(
        F.substring("text", 1, 40), F.lit(" [Source: "), F.col("source"), F.lit(", page "), s(page), F.lit("] in 2024 it was "), s(F.col("doc_id") % 900),
        F.lit(".5, up "), s(F.col("doc_id") % 13), F.lit("% [Source: ghost , page 3]"),
    )
    return d.select("doc_id", answer.alias("answer"), F.concat(F.col("text"), F.lit(" 2023 total "), s(F.col("doc_id") % 700), F.lit(".5")).alias("evidence"), "source", page.alias("page"))


#: A chunk collection over the documents.
COLLECTION_SQL = r"""
collection AS (
  SELECT doc_id AS chunk_id, coalesce(text, '') AS text, source AS source_doc, 1 + doc_id % 50 AS page_number,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_.+%-]+')) AS INTEGER) AS token_count,
         CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'chart' END AS chunk_type
  FROM documents)
"""


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagequarry.functions.text import count_tokens

    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "table").otherwise("chart")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), text.alias("text"), F.col("source").alias("source_doc"), (1 + F.col("doc_id") % 50).alias("page_number"),
        count_tokens(text).alias("token_count"), kind.alias("chunk_type"),
    )


#: Documents with headings: one at the top, one below it, one near the end.
HEADED_SQL = """
headed AS (
  SELECT doc_id, source, '# ' || source || chr(10) || '1.' || (doc_id % 3) || ' ' || lang || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Summary of ' || source || chr(10) ||
         'tail ' || doc_id || ' which is a longer line without an end' || chr(10) || 'and goes on' AS text
  FROM documents)
"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n1."), s(F.col("doc_id") % 3), F.lit(" "), F.col("lang"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\nSummary of "), F.col("source"),
        F.lit("\ntail "), s(F.col("doc_id")), F.lit(" which is a longer line without an end\nand goes on"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))
