"""Queries of tables; Markdown tables are made from the statements of each company."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import sql
from pagequarry.functions import finance
from pagequarry.operators import tables as t
from pagequarry.plans.catalog import MD_TABLES_SQL, STATEMENTS_SQL, md_tables, query, statements, table
from pagequarry.plans.text_queries import _IDENTIFY

_BASE = f"{STATEMENTS_SQL}, {MD_TABLES_SQL}"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = rf"list_filter(list_transform(string_split(md, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: regexp_matches(x, '^\|(.+)\|$') AND NOT regexp_matches(x, '^\|[\s\-:|]+\|$'))"
_CELLS = rf"list_transform(string_split(regexp_extract(l, '^\|(.+)\|$', 1), '|'), lambda x: {_STRIP.format('x')})"
_ROWS = f"ln AS (SELECT company, unnest({_LINES}) AS l, unnest(range(0, len({_LINES}))) AS row_no FROM md), pr AS (SELECT company, row_no, {_CELLS} AS kept, list_filter({_CELLS}, lambda x: x <> '') AS cells FROM ln)"


def _parsed(spark: SparkSession, sf_dir: str, keep_empty: bool) -> DataFrame:
    rows = md_tables(spark, sf_dir).select("company", F.posexplode(t.parse_markdown(F.col("md"), keep_empty)).alias("row_no", "cells"))
    return rows.select("company", "row_no", F.size("cells").alias("n_cells"), F.array_join("cells", "~").alias("cells"))


@query(f"WITH {_BASE}, {_ROWS} SELECT company, CAST(row_no AS INTEGER) AS row_no, CAST(len(cells) AS INTEGER) AS n_cells, array_to_string(cells, '~') AS cells FROM pr")
def md_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, False)


@query(f"WITH {_BASE}, {_ROWS} SELECT company, CAST(row_no AS INTEGER) AS row_no, CAST(len(cells) AS INTEGER) AS n_cells, array_to_string(cells, '~') AS cells FROM pr")
def sql_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``md_table_parse`` as SQL text over the registered functions."""
    sql.register(spark)
    return spark.sql("SELECT company, r.row_no, size(r.cells) AS n_cells, array_join(r.cells, '~') AS cells FROM {tables} t, LATERAL md_table(t.md) r", tables=md_tables(spark, sf_dir))


@query(
    f"WITH {_BASE}, {_ROWS} SELECT company, CAST(row_no - 1 AS INTEGER) AS pos, TRY_CAST(regexp_extract(replace(cells[2], ',', ''), '-?[\\d,]+\\.?\\d*') AS DOUBLE) AS value, cells[1] AS year FROM pr WHERE row_no > 0"
)
def sql_metric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metric_extract`` as SQL text over the registered functions."""
    sql.register(spark)
    text = """
    WITH parsed AS (SELECT company, md_rows(md) AS rows FROM {tables}),
    placed AS (SELECT company, rows, header_place(rows[0], array('Revenue', 'Total Revenue', 'Net Revenue', 'Operating Revenue')) AS at, header_place(rows[0], array('year')) AS year_at FROM parsed),
    body AS (SELECT company, at, year_at, b.pos, b.col AS cells FROM placed, LATERAL posexplode(slice(rows, 2, greatest(size(rows) - 1, 0))) b WHERE at > 0)
    SELECT company, pos, first_number(get(cells, at - 1)) AS value, get(cells, year_at - 1) AS year FROM body WHERE first_number(get(cells, at - 1)) IS NOT NULL
    """
    return spark.sql(text, tables=md_tables(spark, sf_dir))


@query(f"WITH {_BASE}, {_ROWS} SELECT company, CAST(row_no - 1 AS INTEGER) AS row_no, kept[1] AS Year, kept[5] AS \"Current Assets\", CAST(NULL AS VARCHAR) AS Missing FROM pr WHERE row_no > 0")
def sql_markdown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of Markdown tables by the names of their headers, which the call states."""
    sql.register(spark)
    return spark.sql("SELECT * FROM markdown_columns(TABLE(SELECT * FROM {tables}) PARTITION BY (company), 'md', 'Year, Current Assets, Missing')", tables=md_tables(spark, sf_dir))


@query(f"WITH {_BASE}, {_ROWS} SELECT company, CAST(row_no AS INTEGER) AS row_no, CAST(len(kept) AS INTEGER) AS n_cells, array_to_string(kept, '~') AS cells FROM pr")
def md_table_parse_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, True)


_CSV = "SELECT c_custkey, ' Name , Segment' || chr(9) || 'Key ' || chr(10) || chr(10) || c_name || ',' || c_mktsegment || chr(9) || ' ' || c_custkey AS csv FROM customer"


@query(
    f"WITH c AS ({_CSV}), l AS (SELECT c_custkey, list_filter(list_transform(string_split(csv, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ls FROM c), "
    "r AS (SELECT c_custkey, unnest(ls) AS l, unnest(range(0, len(ls))) AS row_no FROM l) "
    rf"SELECT c_custkey, CAST(row_no AS INTEGER) AS row_no, array_to_string(list_transform(regexp_split_to_array(l, '[,\t]'), lambda x: {_STRIP.format('x')}), '~') AS cells FROM r"
)
def csv_table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    csv = F.concat(F.lit(" Name , Segment\tKey \n\n"), F.col("c_name"), F.lit(","), F.col("c_mktsegment"), F.lit("\t "), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", F.posexplode(t.parse_delimited(csv)).alias("row_no", "cells")).select("c_custkey", "row_no", F.array_join("cells", "~").alias("cells"))


_CELL_SQL = "replace({}, '|', chr(92) || '|')"
_RENDER = f"'| ' || array_to_string(list_transform(cells, lambda x: {_CELL_SQL.format('x')}), ' | ') || ' |'"


@query(
    "WITH r AS (SELECT n_regionkey, n_nationkey, [n_name || '|x', CAST(n_nationkey AS VARCHAR)] AS cells FROM nation) "
    f"SELECT n_regionkey, '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg({_RENDER}, chr(10) ORDER BY n_nationkey) AS md FROM r GROUP BY 1"
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("n_nationkey", F.array(F.concat("n_name", F.lit("|x")), F.col("n_nationkey").cast("string")).alias("cells"))
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select("n_regionkey", t.render_markdown(F.array(F.lit("Name"), F.lit("Key")), F.col("rows.cells")).alias("md"))


@query(
    f"WITH {_BASE}, {_ROWS} SELECT company, CAST(row_no - 1 AS INTEGER) AS pos, TRY_CAST(regexp_extract(replace(cells[2], ',', ''), '-?[\\d,]+\\.?\\d*') AS DOUBLE) AS value, cells[1] AS year FROM pr WHERE row_no > 0"
)
def metric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.metric_values(md_tables(spark, sf_dir), "revenue")


_ALIAS_SQL = ", ".join(f"('{f}', {i}, [{', '.join(chr(39) + a.lower().replace(chr(39), chr(39) * 2) + chr(39) for a in aliases)}])" for i, (f, aliases) in enumerate(t.STANDARD_FIELDS.items()))
_HEADERS = "SELECT p_partkey, list_filter([CASE p_partkey % 4 WHEN 0 THEN 'Net Sales' WHEN 1 THEN 'Total Assets' WHEN 2 THEN 'Profit' ELSE 'Year' END, CASE p_partkey % 3 WHEN 0 THEN 'Total Debt' WHEN 1 THEN 'EBIT' ELSE 'Gross Margin' END, 'Equity ' || p_size, p_brand], lambda x: x <> '') AS hs FROM part"


@query(
    f"WITH a(field, i, aliases) AS (VALUES {_ALIAS_SQL}), h AS ({_HEADERS}), e AS (SELECT p_partkey, unnest(hs) AS header, unnest(range(0, len(hs))) AS pos FROM h), "
    "m AS (SELECT field, 'Table_' || p_partkey AS tbl, header, pos, row_number() OVER (PARTITION BY field, p_partkey ORDER BY pos) AS n FROM e, a WHERE len(list_filter(aliases, lambda x: contains(lower(header), x))) > 0) "
    'SELECT field, tbl AS "table", header, CAST(pos AS INTEGER) AS column_index FROM m WHERE n = 1'
)
def cross_table_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    heads = F.array(
        F.when(k % 4 == 0, "Net Sales").when(k % 4 == 1, "Total Assets").when(k % 4 == 2, "Profit").otherwise("Year"), F.when(k % 3 == 0, "Total Debt").when(k % 3 == 1, "EBIT").otherwise("Gross Margin"),
        F.concat(F.lit("Equity "), F.col("p_size").cast("string")), F.col("p_brand"),
    )
    named = table(spark, sf_dir, "part").select(F.concat(F.lit("Table_"), k.cast("string")).alias("name"), F.filter(heads, lambda x: x != "").alias("head"))
    return t.field_map(named, "name", "head")


_ASK = ["current ratio of the year", "net profit margin", "roe", "gpm", "interest coverage", "return on assets", "p/e"]
_LATE_SQL = """tabs AS (SELECT company, 1 AS ord, md FROM md UNION ALL SELECT company, 2, 'Gross Profit,Interest Expense,Net Income' || chr(10) || CAST(CAST(arg_min(gross_profit, fy) AS DECIMAL(18, 2)) AS VARCHAR) || ',n/a,-' FROM statements GROUP BY company)"""


def _tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's Markdown table, and a later delimited one that adds a field and fails to override another."""
    late = statements(spark, sf_dir).groupBy("company").agg(F.min_by("gross_profit", "fy").cast("decimal(18,2)").cast("string").alias("g"))
    text = F.concat(F.lit("Gross Profit,Interest Expense,Net Income\n"), F.col("g"), F.lit(",n/a,-"))
    return md_tables(spark, sf_dir).select("company", F.lit(1).alias("ord"), "md").union(late.select("company", F.lit(2), text))


_FIELDS_SQL = (
    "fl AS (SELECT company, CAST(CAST(arg_min(revenue, fy) AS DECIMAL(18, 2)) AS DOUBLE) AS revenue, CAST(CAST(arg_min(net_income, fy) AS DECIMAL(18, 2)) AS DOUBLE) AS net_income, CAST(CAST(arg_min(gross_profit, fy) AS DECIMAL(18, 2)) AS DOUBLE) AS gross_profit, "
    "CAST(CAST(arg_min(current_assets, fy) AS DECIMAL(18, 2)) AS DOUBLE) AS current_assets FROM statements GROUP BY company)"
)


@query(f"WITH {STATEMENTS_SQL}, {_FIELDS_SQL} SELECT company, revenue, net_income, gross_profit, current_assets, current_assets AS total_assets, CAST(NULL AS DOUBLE) AS interest_expense FROM fl")
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.extract_fields(_tabs(spark, sf_dir), "company", "ord", "md")
    return found.select("company", "revenue", "net_income", "gross_profit", "current_assets", "total_assets", "interest_expense")


_ASKS_SQL = "unnest([" + ", ".join(f"'{a}'" for a in _ASK) + "])"


@query(
    f"WITH {STATEMENTS_SQL}, {_FIELDS_SQL}, a AS (SELECT fl.*, {_ASKS_SQL} AS q FROM fl), m AS (SELECT *, {_IDENTIFY} AS metric FROM a), "
    "v AS (SELECT company, metric, round(CASE metric WHEN 'net_profit_margin' THEN net_income / revenue WHEN 'roe' THEN net_income WHEN 'gross_profit_margin' THEN gross_profit / revenue WHEN 'roa' THEN net_income / current_assets WHEN 'pe_ratio' THEN 0.0 / net_income END, 4) AS value, "
    "CASE metric WHEN 'net_profit_margin' THEN '%' WHEN 'gross_profit_margin' THEN '%' WHEN 'current_ratio' THEN 'x' WHEN 'interest_coverage' THEN 'x' WHEN 'pe_ratio' THEN 'x' ELSE '' END AS unit, "
    "CASE metric WHEN 'net_profit_margin' THEN 2 WHEN 'roe' THEN 3 WHEN 'gross_profit_margin' THEN 3 WHEN 'roa' THEN 2 WHEN 'pe_ratio' THEN 4 ELSE 2 END AS need FROM m) "
    "SELECT company, metric, value, unit, CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 5.0::DOUBLE / need) END AS confidence FROM v"
)
def financial_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about each company's tables: the metric is read from the question, its fields from the tables."""
    found = t.extract_fields(_tabs(spark, sf_dir), "company", "ord", "md").withColumn("q", F.explode(F.array(*map(F.lit, _ASK))))
    named = found.withColumn("metric", finance.identify_metric(F.col("q")))
    fields = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in t.CALCULATOR_FIELDS), F.lit(0))
    need = F.element_at(F.create_map(*(F.lit(x) for p in finance.REQUIRED_FIELDS.items() for x in p)), F.col("metric"))
    value = finance.compute_metric(F.col("metric"), lambda n: F.col(n))
    rows = named.select("company", "metric", value.alias("value"), finance.metric_unit(F.col("metric")).alias("unit"), (fields / need).alias("c"))
    return rows.select("company", "metric", "value", "unit", F.when(F.col("value").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("c"))).alias("confidence"))


_FRAG = """frag AS (SELECT n_regionkey AS tid, page, row_no, cells FROM (
  SELECT n_regionkey, p AS page, 0 AS row_no, ['Name', 'Key'] AS cells FROM (SELECT DISTINCT n_regionkey, n_nationkey % 2 AS p FROM nation UNION SELECT r_regionkey, 0 FROM region)
  UNION ALL SELECT n_regionkey, n_nationkey % 2, 1 + n_nationkey, [n_name, CAST(n_nationkey AS VARCHAR)] FROM nation))"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per region, dealt over two pages that both carry the header."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("tid"), (F.col("n_nationkey") % 2).alias("page"), "n_nationkey", "n_name")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("tid"), F.lit(0).alias("page"))
    heads = n.select("tid", "page").union(regions).distinct().select("tid", "page", F.lit(0).alias("row_no"), F.array(F.lit("Name"), F.lit("Key")).alias("cells"))
    return heads.union(n.select("tid", "page", (1 + F.col("n_nationkey")).alias("row_no"), F.array(F.col("n_name"), F.col("n_nationkey").cast("string"))))


@query(f"WITH {_FRAG}, b AS (SELECT tid, string_agg(array_to_string(cells, '~'), chr(10) ORDER BY page, row_no) AS body, count(*) AS n FROM frag WHERE row_no > 0 GROUP BY 1) SELECT CAST(tid AS INTEGER) AS tid, 'Name~Key' AS head, body, CAST(n AS INTEGER) AS n_rows FROM b")
def cross_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = t.merge_pages(_fragments(spark, sf_dir), "tid")
    return merged.select("tid", F.array_join("head", "~").alias("head"), F.array_join(F.transform("body", lambda c: F.array_join(c, "~")), "\n").alias("body"), F.size("body").alias("n_rows"))


@query(f"WITH {_FRAG}, b AS (SELECT tid, string_agg({_RENDER}, chr(10) ORDER BY page, row_no) AS body, count(*) AS n FROM frag WHERE row_no > 0 GROUP BY 1), p AS (SELECT tid, count(DISTINCT page) AS np FROM frag GROUP BY 1) "
       "SELECT CAST(tid AS INTEGER) AS tid, '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || body AS md, CAST(n + 1 AS INTEGER) AS num_rows, 2 AS num_cols, np > 1 AS is_cross_page FROM b JOIN p USING (tid)")  # fmt: skip
def table_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of table rows on pages to whole tables: merged, rendered, measured."""
    frag = _fragments(spark, sf_dir)
    pages = frag.groupBy("tid").agg(F.count_distinct("page").alias("np"))
    merged = t.merge_pages(frag, "tid").join(pages, "tid")
    return merged.select("tid", t.render_markdown(F.col("head"), F.col("body")).alias("md"), (F.size("body") + 1).alias("num_rows"), F.size("head").alias("num_cols"), (F.col("np") > 1).alias("is_cross_page"))


@query("WITH c AS (SELECT o_custkey AS tid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderpriority AS text FROM orders), g AS (SELECT tid, pos // 3 AS row_no, string_agg(text, '~' ORDER BY pos) AS cells, count(*) AS n FROM c GROUP BY 1, 2) SELECT tid, row_no, cells FROM g WHERE n = 3")
def cells_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    cells = o.select(F.col("o_custkey").alias("tid"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos"), F.col("o_orderpriority").alias("text"))
    return t.cells_to_rows(cells, "tid", 3).select("tid", "row_no", F.array_join("cells", "~").alias("cells"))


@query("SELECT p_partkey, CAST(i // 8 AS INTEGER) AS row_no, CAST(i % 8 AS INTEGER) AS col_no, CAST(floor((100 + p_size) * (i % 8) / 8.0) AS INTEGER) AS x1, CAST(floor((60 + p_size) * (i // 8) / 10.0) AS INTEGER) AS y1, "
       "CAST(floor((100 + p_size) * (i % 8 + 1) / 8.0) AS INTEGER) AS x2, CAST(floor((60 + p_size) * (i // 8 + 1) / 10.0) AS INTEGER) AS y2, i // 8 = 0 AS is_header FROM part, range(0, 80) g(i)")  # fmt: skip
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size")).alias("width"), (60 + F.col("p_size")).alias("height"))
    return t.grid_cells(images).drop("width", "height")


_BIG = """big AS (SELECT n_regionkey AS table_id, s_suppkey, [s_name, CAST(s_suppkey AS VARCHAR)] AS cells, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query(
    f"WITH {_BIG}, p AS (SELECT table_id, CASE WHEN n > 10 THEN i // 10 ELSE 0 END AS part, n > 10 AS sp, arg_min(cells[1], i) AS sec, string_agg({_RENDER}, chr(10) ORDER BY i) AS body, count(*) AS k FROM big GROUP BY 1, 2, 3), "
    "x AS (SELECT table_id, part, sp, CASE WHEN sp THEN sec END AS section, k, CASE WHEN sp THEN '**Section: ' || sec || '**' || chr(10) || chr(10) ELSE '' END || '<!-- Table: T' || table_id || ' -->' || chr(10) || chr(10) || "
    "CASE WHEN sp AND part > 0 THEN '| [continued] | Name | Key (id) |' || chr(10) || '| --- | --- | --- |' WHEN sp THEN '| Name | Key (id) |' || chr(10) || '| --- | --- |' ELSE '| Name | Key |' || chr(10) || '| --- | --- |' END || chr(10) || body || "
    "CASE WHEN table_id % 2 = 0 THEN chr(10) || chr(10) || '*Footnote: note*' ELSE '' END AS text FROM p) "
    "SELECT CAST(table_id AS INTEGER) AS table_id, CAST(part AS INTEGER) AS part, sp AS is_partial, section, text, CAST(k AS INTEGER) AS num_rows, 2 AS num_cols, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_.+%-]+')) AS INTEGER) AS token_count FROM x"
)
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each region as one table, in chunks of ten rows."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    row = F.struct("s_suppkey", F.array(F.col("s_name"), F.col("s_suppkey").cast("string")).alias("cells"))
    whole = s.groupBy(F.col("n_regionkey").cast("int").alias("table_id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    note = F.when(F.col("table_id") % 2 == 0, "note").otherwise("")
    shaped = whole.select("table_id", F.array(F.lit("Name"), F.lit("Key")).alias("head"), F.col("r.cells").alias("body"), F.concat(F.lit("T"), F.col("table_id").cast("string")).alias("table_name"), note.alias("footnote"), F.array(F.lit(""), F.lit("id")).alias("column_units"))
    return t.chunk_tables(shaped, rows=10)
