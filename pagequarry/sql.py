"""The library's expressions in SQL text: temporary functions of a session, and a table function for Markdown tables.

    register(spark)
    spark.sql("SELECT company, r.row_no, r.cells FROM tables, LATERAL md_table(md) r")
    spark.sql("SELECT * FROM markdown_columns(TABLE(tables) PARTITION BY (company), 'md', 'Year, Total Revenue')")

The functions are SQL themselves, so that the optimizer sees through them; only ``markdown_columns``, whose columns depend on its
arguments, runs in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_MD = r"'^\\|(.+)\\|$'"
_RULE = r"'^\\|[\\s\\-:|]+\\|$'"
_TRIMMED = r"regexp_replace({}, '^\\s+|\\s+$', '')"
_CELLS = f"transform(split(regexp_extract(l, {_MD}, 1), '\\\\|'), c -> {_TRIMMED.format('c')})"

#: name -> what follows CREATE TEMPORARY FUNCTION; later ones use earlier ones.
FUNCTIONS = {
    "strip_text": f"(s STRING) RETURNS STRING RETURN {_TRIMMED.format('s')}",
    "count_tokens": r"(s STRING) RETURNS INT RETURN size(regexp_extract_all(s, '[\\p{L}\\p{N}_.+%-]+', 0))",
    "count_spaced": r"(s STRING) RETURNS INT RETURN size(array_remove(split(s, '\\s+'), ''))",
    "md_cells": f"(md STRING) RETURNS ARRAY<ARRAY<STRING>> RETURN transform(filter(transform(split(md, '\\n'), l -> {_TRIMMED.format('l')}), l -> l RLIKE {_MD} AND NOT l RLIKE {_RULE}), l -> {_CELLS})",
    "md_rows": "(md STRING) RETURNS ARRAY<ARRAY<STRING>> RETURN transform(md_cells(md), r -> filter(r, c -> c <> ''))",
    "md_table": "(md STRING) RETURNS TABLE (row_no INT, cells ARRAY<STRING>) RETURN SELECT p.pos, p.col FROM (SELECT md_rows(md) AS rows) x, LATERAL posexplode(x.rows) p",
    "header_place": "(head ARRAY<STRING>, aliases ARRAY<STRING>) RETURNS INT RETURN CAST(array_position(transform(head, h -> exists(aliases, a -> contains(lower(h), lower(a)))), true) AS INT)",
    "first_number": r"(s STRING) RETURNS DOUBLE RETURN try_cast(nullif(regexp_extract(replace(s, ',', ''), '-?[\\d,]+\\.?\\d*', 0), '') AS DOUBLE)",
    "ratio_percent": "(part DOUBLE, whole DOUBLE) RETURNS DOUBLE RETURN round(try_divide(part, whole) * 100, 4)",
    "yoy_percent": "(current_value DOUBLE, prior_value DOUBLE) RETURNS DOUBLE RETURN round(try_divide(current_value - prior_value, prior_value) * 100, 4)",
    "cagr_percent": "(start_value DOUBLE, end_value DOUBLE, years DOUBLE) RETURNS DOUBLE RETURN CASE WHEN start_value > 0 AND years > 0 AND end_value >= 0 THEN round((pow(end_value / start_value, 1 / years) - 1) * 100, 4) END",
}


class MarkdownColumns:
    """Body rows of the Markdown tables in a column, with the input's other columns, row_no and a string for each wanted header.

    ``columns`` are headers, parted by commas; a header that a table lacks, and a short row, give null. Without a partition any rows of the
    input may meet in one instance, which keeps nothing between them.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or text.value is None or columns.value is None:
            raise ValueError("markdown_columns takes a table, the name of its text column, and the wanted headers")
        if text.value not in rows.dataType.names:
            raise ValueError(f"the table has no column {text.value}")
        kept = [f for f in rows.dataType if f.name != text.value]
        return AnalyzeResult(schema=T.StructType([*kept, T.StructField("row_no", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in _names(columns.value))]))

    def eval(self, rows: Row, text: str, columns: str) -> Iterator[tuple]:
        own = tuple(v for k, v in rows.asDict().items() if k != text)
        table = [[c.strip() for c in line.strip()[1:-1].split("|")] for line in (rows[text] or "").split("\n") if _is_row(line.strip())]
        for number, cells in enumerate(table[1:]):
            by_head = dict(reversed([*zip(table[0], cells, strict=False)]))  # of equal headers the first
            yield (*own, number, *(by_head.get(c) for c in _names(columns)))


def _names(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(",") if c.strip()]


def _is_row(line: str) -> bool:
    """A line between bars that holds more than rules."""
    return len(line) > 2 and line[0] == line[-1] == "|" and bool(set(line[1:-1]) - set(" \t-:|"))


def register(spark: SparkSession) -> None:
    """Make all functions known to the session, in place of temporary ones of their names."""
    from pyspark.sql.functions import udtf

    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("markdown_columns", udtf(MarkdownColumns))
