"""Markdown and delimited tables: parsing, rendering, metrics, fields, merging over pages, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import count_tokens, escape_cell, strip

# Names under which tables carry a metric, a standard field or a calculator's field.
METRIC_ALIASES = {
    "revenue": ["Revenue", "Total Revenue", "Net Revenue", "Operating Revenue"],
    "net_income": ["Net Income", "Net Profit", "Profit Attributable"],
    "gross_profit": ["Gross Profit", "Gross Margin"],
    "operating_income": ["Operating Income", "EBIT", "Operating Profit"],
    "total_assets": ["Total Assets", "Assets"],
    "total_liabilities": ["Total Liabilities", "Total Debt", "Liabilities"],
    "shareholders_equity": ["Shareholders' Equity", "Equity", "Total Equity"],
    "current_assets": ["Current Assets"],
    "current_liabilities": ["Current Liabilities"],
    "inventory": ["Inventories", "Inventory"],
    "ebitda": ["EBITDA"],
    "eps": ["EPS", "Earnings Per Share", "Diluted EPS"],
    "roe": ["ROE", "Return on Equity"],
    "roa": ["ROA", "Return on Assets"],
}
STANDARD_FIELDS = {
    "revenue": ["Revenue", "Total Revenue", "Net Revenue", "Operating Revenue", "Sales"],
    "net_income": ["Net Income", "Net Profit", "Profit", "Net Earnings"],
    "gross_profit": ["Gross Profit", "Gross Margin"],
    "total_assets": ["Total Assets", "Assets"],
    "total_liabilities": ["Total Liabilities", "Total Debt", "Liabilities"],
    "shareholders_equity": ["Shareholders' Equity", "Equity", "Total Equity"],
    "ebitda": ["EBITDA", "EBIT"],
}
CALCULATOR_FIELDS = {
    "revenue": ["Revenue", "Total Revenue", "Revenue (B USD)", "Net Revenue"],
    "net_income": ["Net Income", "Net Profit", "Net Income Attributable"],
    "gross_profit": ["Gross Profit", "Gross Margin"],
    "operating_income": ["Operating Income", "EBIT", "Operating Profit"],
    "total_assets": ["Total Assets", "Assets"],
    "total_liabilities": ["Total Liabilities", "Total Debt", "Liabilities"],
    "shareholders_equity": ["Shareholders' Equity", "Equity", "Total Equity"],
    "current_assets": ["Current Assets"],
    "current_liabilities": ["Current Liabilities"],
    "inventory": ["Inventories", "Inventory"],
    "equity": ["Shareholders' Equity", "Equity", "Total Equity"],
    "ebit": ["EBIT", "Operating Income"],
    "ebitda": ["EBITDA"],
    "interest_expense": ["Interest Expense", "Interest"],
    "cogs": ["Cost of Goods Sold", "COGS"],
    "nopat": ["NOPAT", "Net Operating Profit After Tax"],
    "invested_capital": ["Invested Capital", "Capital Employed"],
}
_SEPARATOR, _ROW = r"^\|[\s\-:|]+\|$", r"^\|(.+)\|$"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def parse_markdown(text: Column, keep_empty: bool = False) -> Column:
    """array<array<string>> of a Markdown table's rows, the header first; empty cells go unless they are kept by position."""
    rows = F.filter(_lines(text), lambda x: x.rlike(_ROW) & ~x.rlike(_SEPARATOR))
    cells = lambda x: F.transform(F.split(F.regexp_extract(x, _ROW, 1), r"\|"), strip)
    return F.transform(rows, cells if keep_empty else lambda x: F.filter(cells(x), lambda c: c != ""))


def parse_delimited(text: Column) -> Column:
    """array<array<string>> of lines split at commas and tabs, without quoting."""
    return F.transform(_lines(text), lambda x: F.transform(F.split(x, "[,\t]"), strip))


def header(rows: Column) -> Column:
    return F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))


def body(rows: Column) -> Column:
    return F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))


def render_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_cell), " | "), F.lit(" |"))


def render_markdown(head: Column, rows: Column) -> Column:
    """A Markdown table; pipes in cells are escaped."""
    marks = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(render_row(head), marks), F.transform(rows, render_row)), "\n")


def holds_alias(name: Column, aliases: list[str]) -> Column:
    """Whether a header holds one of the aliases, whatever the case."""
    low = F.lower(name)
    found = low.contains(aliases[0].lower())
    for a in aliases[1:]:
        found = found | low.contains(a.lower())
    return found


def _named(aliases: list[str]) -> Callable[[Column], Column]:
    """A test of one argument; a lambda with a default would be taken for one with two."""
    return lambda head: holds_alias(head, aliases)


def _first_where(head: Column, test: Callable[[Column], Column]) -> Column:
    """1-based position of the first header that meets a test, else 0."""
    return F.array_position(F.transform(head, test), F.lit(True)).cast("int")


def metric_values(tables: DataFrame, metric: str, context: tuple[str, ...] = ("year",), text: str = "md") -> DataFrame:
    """A row for each numeric value of a metric: the other columns of ``tables``, pos, value and the context's cells.

    The first header that holds an alias is the metric's; of headers that hold a context's name the last counts. Commas are
    ignored, the first number of the cell is the value, a scale suffix isn't applied.
    """
    aliases = METRIC_ALIASES.get(metric.lower(), [metric])
    others = [c for c in tables.columns if c != text]
    parsed = tables.select(*others, parse_markdown(F.col(text)).alias("rows")).select(*others, header(F.col("rows")).alias("head"), body(F.col("rows")).alias("body"))
    at = _first_where(F.col("head"), _named(aliases)).alias("at")
    last = [F.size("head") + 1 - F.nullif(_first_where(F.reverse("head"), _named([c])), F.lit(0)) for c in context]
    placed = parsed.select(*others, "body", at, *(p.alias(f"_at_{c}") for c, p in zip(context, last, strict=True))).where("at > 0")
    cells = placed.select(*others, "at", *(f"_at_{c}" for c in context), F.posexplode("body").alias("pos", "cells"))
    number = F.regexp_extract(F.replace(F.get("cells", F.col("at") - 1), F.lit(","), F.lit("")), r"-?[\d,]+\.?\d*", 0)
    return cells.withColumn("value", F.when(number != "", number).try_cast("double")).where("value is not null").select(
        *others, "pos", "value", *(F.get("cells", F.col(f"_at_{c}") - 1).alias(c) for c in context)
    )


def field_map(tables: DataFrame, name: str, head: str, fields: dict[str, list[str]] = STANDARD_FIELDS) -> DataFrame:
    """(field, table, header, column_index) of the first header in each table that holds an alias of a standard field."""
    found = [F.struct(F.lit(f).alias("field"), _first_where(F.col(head), _named(a)).alias("at")) for f, a in fields.items()]
    rows = tables.select(F.col(name).alias("table"), F.col(head).alias("_head"), F.explode(F.array(*found)).alias("m")).where("m.at > 0")
    return rows.select("m.field", "table", F.get("_head", F.col("m.at") - 1).alias("header"), (F.col("m.at") - 1).alias("column_index"))


def fields_of(rows: Column, aliases: list[str]) -> Column:
    """The first number in row order, then alias order, then column order, of cells under a header that holds an alias."""
    head = header(rows)

    def of_row(cells: Column) -> Column:
        return F.coalesce(*(under(cells, a.lower()) for a in aliases))

    def under(cells: Column, alias: str) -> Column:
        number = lambda c: F.nullif(F.regexp_replace(c, r"[^\d.\-]", ""), F.lit("")).try_cast("double")
        values = F.zip_with(cells, F.slice(head, F.lit(1), F.size(cells)), lambda c, h: F.when(F.lower(h).contains(alias), number(c)))
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    return F.get(F.filter(F.transform(body(rows), of_row), lambda v: v.isNotNull()), F.lit(0))


def extract_fields(tables: DataFrame, key: str, order: str, text: str, fields: dict[str, list[str]] = CALCULATOR_FIELDS) -> DataFrame:
    """One row a key with a column for each field; a later table of the key (by ``order``) overrides an earlier one."""
    markdown = parse_markdown(F.col(text), keep_empty=True)
    parsed = tables.select(key, order, F.when(F.size(markdown) > 0, markdown).otherwise(parse_delimited(F.col(text))).alias("_rows"))
    values = parsed.select(key, order, *(fields_of(F.col("_rows"), a).alias(f) for f, a in fields.items()))
    return values.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def cells_to_rows(cells: DataFrame, table: str, columns: int) -> DataFrame:
    """(table, row_no, cells) of reading-order cells (table, pos, text): rows of ``columns`` cells, a short tail is dropped."""
    rows = cells.groupBy(table, F.floor(F.col("pos") / columns).alias("row_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    return rows.where(F.size("c") == columns).select(table, "row_no", F.col("c.text").alias("cells"))


def spanning_cells(cells: DataFrame) -> DataFrame:
    """Cells that span several rows or columns, of cells with ``row_span`` and ``col_span``."""
    return cells.where((F.col("row_span") > 1) | (F.col("col_span") > 1))


def merge_pages(rows: DataFrame, table: str) -> DataFrame:
    """(table, head, body) of row fragments (table, page, row_no, cells).

    The first page's first row is the header; a later page's first row goes if it repeats the header.
    """
    ordered = rows.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("page", "row_no", "cells"))).alias("r"))
    head = F.get("r", F.lit(0))
    rest = F.filter(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), lambda x: ~((x["row_no"] == 0) & (x["cells"] == head["cells"])))
    return ordered.select(table, head["cells"].alias("head"), F.transform(rest, lambda x: x["cells"]).alias("body"))


def join_fragments(fragments: Column) -> Column:
    """The rows of a table from those of its fragments, array<array<array<string>>>: the first fragment's first row is the header, and a
    later fragment's first row goes if it repeats it."""
    head = header(F.get(fragments, F.lit(0)))
    return F.flatten(F.transform(fragments, lambda rows, i: F.when((i > 0) & (header(rows) == head), body(rows)).otherwise(rows)))


def grid_cells(images: DataFrame, rows: int = 10, columns: int = 8) -> DataFrame:
    """Cells of an even grid over images (table, width, height), for where no structure model decodes them."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(rows * columns - 1)))
    placed = images.withColumn("_i", grid).withColumns({"row_no": F.floor(F.col("_i") / columns).cast("int"), "col_no": (F.col("_i") % columns).cast("int")})
    edge = lambda size, n, i: F.floor(F.col(size) * (F.col(i[0]) + i[1]) / n).cast("int")
    return placed.drop("_i").withColumns({
        "x1": edge("width", columns, ("col_no", 0)), "y1": edge("height", rows, ("row_no", 0)),
        "x2": edge("width", columns, ("col_no", 1)), "y2": edge("height", rows, ("row_no", 1)), "is_header": F.col("row_no") == 0,
    })


def chunk_tables(tables: DataFrame, rows: int = 50) -> DataFrame:
    """Chunks of tables (table_id, head, body, table_name, footnote, column_units array<string>): a row for each chunk.

    A table of more than ``rows`` rows is split; its parts repeat the header with units, parts after the first with a leading
    "[continued]", and name the first cell as their section.
    """
    n = F.size("body")
    split = n > rows
    starts = F.when(split, F.sequence(F.lit(0), n - 1, F.lit(rows))).otherwise(F.array(F.lit(0)))
    parts = tables.withColumn("_split", split).select("*", F.posexplode(starts).alias("part", "_start"))
    parts = parts.withColumn("part_rows", F.when(F.col("_split"), F.slice("body", F.col("_start") + 1, rows)).otherwise(F.col("body")))
    units = F.zip_with("head", F.slice("column_units", 1, F.size("head")), lambda h, u: F.when(F.coalesce(u, F.lit("")) != "", F.concat(h, F.lit(" ("), u, F.lit(")"))).otherwise(h))
    named = F.when(F.col("_start") > 0, F.concat(F.array(F.lit("[continued]")), units)).otherwise(units)
    parts = parts.withColumn("part_head", F.when(F.col("_split"), named).otherwise(F.col("head")))
    section = F.when(F.col("_split"), F.get(F.get("part_rows", F.lit(0)), F.lit(0)))
    line = lambda test, *text: F.when(test, F.concat(*text))
    text = F.concat_ws(
        "\n", line(section != "", F.lit("**Section: "), section, F.lit("**\n")), line(F.col("table_name") != "", F.lit("<!-- Table: "), F.col("table_name"), F.lit(" -->\n")),
        render_markdown(F.col("part_head"), F.col("part_rows")), line(F.col("footnote") != "", F.lit("\n*Footnote: "), F.col("footnote"), F.lit("*")),
    )
    return parts.select("table_id", "part", F.col("_split").alias("is_partial"), section.alias("section"), text.alias("text"), F.size("part_rows").alias("num_rows"), F.size("head").alias("num_cols")).withColumn("token_count", count_tokens(F.col("text")))
