"""Queries of ingest: pages to tables that go on over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.plans.catalog import query, table
from pagequarry.plans.ingest import chunk_pages

_HEAD, _LINE = "| Key | Status | Day |", "| --- | --- | --- |"
_LISTED_SQL = f"""
o AS (SELECT o_custkey AS c, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' |' AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders),
p AS (SELECT *, 1 + rn // 4 AS page, CASE WHEN c % 3 = 0 AND rn >= 4 THEN 2 ELSE 1 END AS first FROM o),
h AS (SELECT *, first = 1 OR c % 2 = 0 AS headed, row_number() OVER (PARTITION BY c, first ORDER BY rn) AS i FROM p),
g AS (SELECT c, first, CASE WHEN headed THEN '{_HEAD}' ELSE arg_min(r, rn) END AS head, string_agg(r, chr(10) ORDER BY rn) FILTER (headed OR i > 1) AS body, string_agg(DISTINCT page, ',' ORDER BY page) AS pages, max(page) > first AS cross_page FROM h GROUP BY c, first, headed),
x AS (SELECT *, '<!-- Table: page ' || first || ' table 1 -->' || chr(10) || chr(10) || head || chr(10) || '{_LINE}' || coalesce(chr(10) || body, '') AS text FROM g)
"""


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_doc, page_number, text): each customer's orders as one table, four rows a page. Every other customer's pages repeat the
    header; the second page of every third customer begins with a line of text, which ends the table before it."""
    o, c = table(spark, sf_dir, "orders"), F.col("c")
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" | "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" |"))
    own = Window.partitionBy("o_custkey")
    rows = o.select(F.col("o_custkey").alias("c"), row.alias("row"), (F.row_number().over(own.orderBy("o_orderkey")) - 1).alias("rn"), F.count(F.lit(1)).over(own).alias("n"))
    pages = rows.groupBy("c", "n", (1 + F.floor(F.col("rn") / 4)).cast("int").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("rn", "row"))).alias("rows"))
    page = F.col("page_number")
    text = F.concat(
        F.when(page == 1, F.concat(F.lit("Orders of customer "), c.cast("string"), F.lit(".\n\n"))).when((page == 2) & (c % 3 == 0), "Continued below.\n").otherwise(""),
        F.when((page == 1) | (c % 2 == 0), f"{_HEAD}\n{_LINE}\n").otherwise(""), F.array_join("rows.row", "\n"), F.when(page * 4 >= F.col("n"), "\n\nEnd of the list.").otherwise("\n\n"),
    )
    return pages.select(F.concat(F.lit("customer "), c.cast("string")).alias("source_doc"), "page_number", text.alias("text"))


@query(
    f"WITH {_LISTED_SQL} SELECT 'customer ' || c AS source_doc, CAST(first AS BIGINT) AS page_number, cross_page AS is_cross_page, pages, 'page ' || first || ' table 1' AS table_name, text, "
    r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_.+%-]+')) AS BIGINT) AS token_count FROM x"
)
def ingest_joined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the whole ingest; its table chunks, with tables joined over their pages."""
    chunks = chunk_pages(order_pages(spark, sf_dir), table_rows=100_000).where("chunk_type = 'table'")
    return chunks.select("source_doc", "page_number", "is_cross_page", F.array_join(F.col("page_span").cast("array<string>"), ",").alias("pages"), "table_name", "text", "token_count")
