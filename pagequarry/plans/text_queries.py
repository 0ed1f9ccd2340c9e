"""Queries of the text and finance functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import finance, text
from pagequarry.plans.catalog import ANSWERS_SQL, HEADED_SQL, STATEMENTS_SQL, answers, headed, query, statements, table

_TERMS = r"list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}_.]+'), lambda x: len(x) >= 2)"


@query(f"SELECT doc_id, CAST(len({_TERMS}) AS INTEGER) AS n_terms, array_to_string({_TERMS}, ' ') AS terms FROM documents")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = text.search_terms(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", terms.alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_.+%-]+')) AS INTEGER) AS n_tokens FROM documents")
def count_tokens_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.count_tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents")
def count_tokens_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.count_spaced(F.coalesce("text", F.lit(""))).alias("n_tokens"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in text.HEADING_WORDS) + "]"


def level_sql(s: str, font: str | None = None) -> str:
    """CASE for the level of a stripped line."""
    by_size = f" WHEN {font} >= 18 THEN 1 WHEN {font} >= 15 THEN 2 WHEN {font} >= 13 THEN 3 WHEN {font} >= 12 THEN 4" if font else ""
    number = rf"regexp_extract({s}, '^(\d+(?:\.\d+)*)\s+', 1)"
    return (
        rf"CAST(CASE WHEN {s} = '' THEN NULL WHEN len(regexp_extract({s}, '^(#{{1,6}})\s+(.+)', 1)) > 0 THEN len(regexp_extract({s}, '^(#{{1,6}})\s+(.+)', 1)) "
        rf"WHEN {number} <> '' AND len(string_split({number}, '.')) <= 3 THEN len(string_split({number}, '.')) + 1{by_size} "
        rf"WHEN list_contains({_WORDS}, regexp_replace(lower(regexp_extract({s}, '^\S+')), '\.+$', '')) THEN 2 END AS INTEGER)"
    )


@query(
    rf"WITH {HEADED_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM headed), "
    rf"s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l) "
    rf"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {level_sql('s')} AS level, {level_sql('s', '(8 + (doc_id + line_no) % 12)')} AS level_by_font FROM s"
)
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = headed(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    font = 8 + (F.col("doc_id") + F.col("line_no")) % 12
    return lines.select("doc_id", "line_no", text.heading_level(F.col("line")).alias("level"), text.heading_level(F.col("line"), font).alias("level_by_font"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n([a-z])', ' \1', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_CLEAN.format(t="coalesce(text, '')")} AS cleaned FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_paragraph(F.coalesce("text", F.lit(""))).alias("cleaned"))


def _translate_sql(t: str, pair: tuple[str, str]) -> str:
    return rf"regexp_replace(translate({t}, '{pair[0]}', '{pair[1]}'), '^\s+|\s+$', '', 'g')"


_CELL = "' ￥' || (doc_id % 1000) || '，' || coalesce(lang, '') || '％—（' || coalesce(source, '') || '）：。【x】 '"


def _cell():
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(F.lit(" ￥"), (F.col("doc_id") % 1000).cast("string"), F.lit("，"), s("lang"), F.lit("％—（"), s("source"), F.lit("）：。【x】 "))


@query(f"SELECT doc_id, {_translate_sql(_CELL, text.OCR_CELL)} AS cell FROM documents")
def ocr_correct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.correct_ocr(_cell()).alias("cell"))


@query(
    f"WITH c AS (SELECT doc_id, lang, {_CELL} AS cell FROM documents) SELECT doc_id, CASE lang WHEN 'en' THEN {_translate_sql('cell', text.OCR_EN)} WHEN 'zh' THEN "
    f"{_translate_sql('cell', text.OCR_ZH)} ELSE {_translate_sql('cell', text.OCR_MIXED)} END AS cell FROM c"
)
def ocr_correct_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.correct_ocr(_cell(), F.coalesce("lang", F.lit(""))).alias("cell"))


@query(
    f"WITH c AS (SELECT source, lang, {_CELL} AS cell FROM documents), x AS (SELECT source, cell, CASE lang WHEN 'en' THEN {_translate_sql('cell', text.OCR_EN)} "
    f"ELSE {_translate_sql('cell', text.OCR_MIXED)} END AS y FROM c) SELECT source, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(*) FILTER (WHERE cell <> y) AS BIGINT) AS n_corrected FROM x GROUP BY source"
)
def ocr_correct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "documents").select("source", _cell().alias("cell"), text.correct_ocr(_cell(), F.coalesce("lang", F.lit(""))).alias("y"))
    return cells.groupBy("source").agg(F.count("*").alias("n_cells"), F.count_if(F.col("cell") != F.col("y")).alias("n_corrected"))


@query(f"WITH {ANSWERS_SQL}, c AS (SELECT doc_id, unnest(regexp_extract_all(answer, '{text.CITATION}', 1)) AS d, unnest(regexp_extract_all(answer, '{text.CITATION}', 2)) AS p FROM answers) "
       r"SELECT doc_id, regexp_replace(d, '^\s+|\s+$', '', 'g') AS cited_doc, CAST(p AS INTEGER) AS cited_page FROM c")  # fmt: skip
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", F.explode(text.citations(F.col("answer"))).alias("c")).select("doc_id", F.col("c.doc").alias("cited_doc"), F.col("c.page").alias("cited_page"))


@query(
    f"WITH {ANSWERS_SQL} SELECT doc_id, array_to_string(regexp_extract_all(answer, '{text.NUMBER}'), '|') AS numbers, array_to_string(regexp_extract_all(answer, '{text.YEAR}', 1), '|') AS years, "
    f"array_to_string(regexp_extract_all(answer, '{text.PERCENT}'), '|') AS percents FROM answers"
)
def number_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("answer")
    return answers(spark, sf_dir).select("doc_id", F.array_join(text.numbers(a), "|").alias("numbers"), F.array_join(text.years(a), "|").alias("years"), F.array_join(text.percents(a), "|").alias("percents"))


_REPLY = """'Result: ```json ' || chr(10) || '{"verdict": "' || CASE doc_id % 3 WHEN 0 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END || '", "confidence": ' || (doc_id % 10) || '.5}' || chr(10) || '```'"""
_BARE = """'I think {"verdict": "PARTIAL", "confidence": ' || (doc_id % 7) || '.25} is right'"""


@query(
    f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'no object' WHEN doc_id % 4 = 2 THEN {_BARE} ELSE {_REPLY} END AS reply FROM documents), "
    r"j AS (SELECT doc_id, CASE WHEN regexp_matches(reply, '(?s)```(?:json)?\s*(\{.*?\})\s*```') THEN regexp_extract(reply, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) WHEN regexp_matches(reply, '(?s)\{.*\}') THEN regexp_extract(reply, '(?s)\{.*\}') END AS j FROM r) "
    "SELECT doc_id, coalesce(json_extract_string(j, '$.verdict'), 'INSUFFICIENT') AS verdict, coalesce(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.0) AS confidence FROM j"
)
def parse_judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    fenced = F.concat(F.lit('Result: ```json \n{"verdict": "'), F.when(n % 3 == 0, "SUFFICIENT").otherwise("INSUFFICIENT"), F.lit('", "confidence": '), s(n % 10), F.lit(".5}\n```"))
    bare = F.concat(F.lit('I think {"verdict": "PARTIAL", "confidence": '), s(n % 7), F.lit(".25} is right"))
    reply = F.when(n % 4 == 3, "no object").when(n % 4 == 2, bare).otherwise(fenced)
    parsed = F.from_json(text.json_in_text(F.col("reply")), "verdict string, confidence double")
    return (
        table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")).select("doc_id", parsed.alias("j"))
        .select("doc_id", F.coalesce("j.verdict", F.lit("INSUFFICIENT")).alias("verdict"), F.coalesce("j.confidence", F.lit(0.0)).alias("confidence"))
    )


_TITLE = "CASE doc_id % 5 WHEN 0 THEN 'Figure ' || doc_id || ': ' WHEN 1 THEN 'FIG. ' || doc_id || ' ' WHEN 2 THEN 'Exhibit' WHEN 3 THEN 'chart: ' ELSE '' END || coalesce(source, '')"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace({_TITLE}, '(?i)^(figure|fig\.|fig|chart|exhibit)\s*\d*[:.\s]*', ''), '^\s+|\s+$', '', 'g') AS title FROM documents")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    s = n.cast("string")
    head = F.when(n % 5 == 0, F.concat(F.lit("Figure "), s, F.lit(": "))).when(n % 5 == 1, F.concat(F.lit("FIG. "), s, F.lit(" "))).when(n % 5 == 2, "Exhibit").when(n % 5 == 3, "chart: ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_title(F.concat(head, F.coalesce("source", F.lit("")))).alias("title"))


# --- finance ---------------------------------------------------------------------------------------------------------

RATIO_SQL = {
    "gross_profit_margin": "gross_profit / revenue * 100", "operating_profit_margin": "operating_income / revenue * 100", "net_profit_margin": "net_income / revenue * 100",
    "roe": "net_income / shareholders_equity * 100", "roa": "net_income / total_assets * 100", "current_ratio": "current_assets / current_liabilities",
    "quick_ratio": "(current_assets - inventory) / current_liabilities", "debt_to_equity": "total_liabilities / shareholders_equity", "debt_to_assets": "total_liabilities / total_assets",
    "interest_coverage": "operating_income / nullif(interest_expense, 0)", "pe_ratio": "market_cap / net_income", "ev_ebitda": "enterprise_value / ebitda",
}


@query(f"WITH {STATEMENTS_SQL} SELECT company, fy, " + ", ".join(f"round({e}, 4) AS {m}" for m, e in RATIO_SQL.items()) + " FROM statements")
def calc_all_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("company", "fy", *(finance.ratio(m, F.col).alias(m) for m in RATIO_SQL))


_CASES = "unnest(['roe', 'ROA', 'current_ratio', 'interest_coverage', 'nothing', 'gross_profit_margin', 'debt_to_equity'])"


@query(
    f"WITH {STATEMENTS_SQL}, c AS (SELECT *, {_CASES} AS metric FROM statements), r AS (SELECT company, fy, metric, CASE WHEN metric = 'debt_to_equity' THEN NULL ELSE round(CASE lower(metric) "
    "WHEN 'roe' THEN net_income / shareholders_equity * 100 WHEN 'roa' THEN net_income / total_assets * 100 WHEN 'interest_coverage' THEN operating_income / nullif(interest_expense, 0) "
    "WHEN 'gross_profit_margin' THEN NULL END, 4) END AS result FROM c) "
    "SELECT company, fy, metric, result, CASE WHEN result IS NULL THEN NULL WHEN lower(metric) LIKE '%coverage%' THEN '%' ELSE '' END AS unit, "
    "CASE WHEN metric = 'nothing' THEN 'Unknown metric: nothing' WHEN metric = 'debt_to_equity' THEN 'Unknown variables' WHEN result IS NULL THEN 'not computable' END AS error FROM r"
)
def calc_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by name over a map of variables; two calls lack a variable, one brings a variable that isn't known."""
    known = ["net_income", "shareholders_equity", "total_assets", "operating_income", "interest_expense"]
    values = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*(F.col(k) for k in known)))
    odd = F.map_concat(values, F.create_map(F.lit("goodwill"), F.lit(1.0)))
    names = ["roe", "ROA", "current_ratio", "interest_coverage", "nothing", "gross_profit_margin", "debt_to_equity"]
    calls = statements(spark, sf_dir).withColumn("metric", F.explode(F.array(*map(F.lit, names))))
    calls = calls.withColumn("given", F.when(F.col("metric") == "debt_to_equity", odd).otherwise(values))
    result, unit, error = finance.calculate(F.col("metric"), F.col("given"))
    return calls.select("company", "fy", "metric", result.alias("result"), unit.alias("unit"), error.alias("error"))


@query(
    f"WITH {STATEMENTS_SQL}, e AS (SELECT company, min(fy) AS y0, max(fy) AS y1, arg_min(revenue, fy) AS a, arg_max(revenue, fy) AS b FROM statements GROUP BY company) "
    "SELECT company, y1 - y0 AS years, CASE WHEN a > 0 AND y1 > y0 AND b >= 0 THEN round((pow(b / a, 1.0 / (y1 - y0)) - 1) * 100, 4) END AS cagr_percent FROM e"
)
def cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = statements(spark, sf_dir).groupBy("company").agg(F.min("fy").alias("y0"), F.max("fy").alias("y1"), F.min_by("revenue", "fy").alias("a"), F.max_by("revenue", "fy").alias("b"))
    years = F.col("y1") - F.col("y0")
    return ends.select("company", years.cast("long").alias("years"), finance.cagr_percent(F.col("a"), F.col("b"), years).alias("cagr_percent"))


@query(
    f"WITH {STATEMENTS_SQL}, p AS (SELECT company, fy, revenue, lag(revenue) OVER (PARTITION BY company ORDER BY fy) AS prior FROM statements) "
    "SELECT company, fy, round((revenue - prior) / nullif(prior, 0) * 100, 4) AS yoy_percent, round(revenue - prior, 4) AS change FROM p"
)
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = statements(spark, sf_dir).withColumn("prior", F.lag("revenue").over(Window.partitionBy("company").orderBy("fy")))
    return rows.select("company", "fy", finance.yoy_percent(F.col("revenue"), F.col("prior")).alias("yoy_percent"), F.round(F.col("revenue") - F.col("prior"), 4).alias("change"))


_UNIT_TEXT = (
    "CASE c_custkey % 11 WHEN 0 THEN '1,234.5M' WHEN 1 THEN (c_custkey % 97) || ' bn' WHEN 2 THEN (c_custkey % 89) || '%' WHEN 3 THEN (c_custkey % 5) || 'wan' WHEN 4 THEN '-' || c_custkey || 'M' "
    "WHEN 5 THEN '$1.2B' WHEN 6 THEN '1.2.3' WHEN 7 THEN (c_custkey % 50) || '万' WHEN 8 THEN '2.5B' WHEN 9 THEN (c_custkey % 31) || 'zz' ELSE c_custkey || '' END"
)
_FACTOR = "CASE lower(u) " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in finance.UNITS.items()) + "{cjk} ELSE 1.0 END"
_F0, _F1 = _FACTOR.format(cjk=""), _FACTOR.format(cjk=" WHEN '万' THEN 10000.0 WHEN '亿' THEN 100000000.0")


@query(
    f"WITH t AS (SELECT c_custkey, {_UNIT_TEXT} AS raw FROM customer), m AS (SELECT c_custkey, raw, regexp_replace(raw, '[, ]', '', 'g') AS c FROM t), "
    r"v AS (SELECT c_custkey, raw, TRY_CAST(nullif(regexp_extract(c, '^([\d.]+)([a-zA-Z%\x{4e00}-\x{9fa5}]*)$', 1), '') AS DOUBLE) AS n, regexp_extract(c, '^([\d.]+)([a-zA-Z%\x{4e00}-\x{9fa5}]*)$', 2) AS u FROM m) "
    f"SELECT c_custkey, raw, round(n * CAST({_F0} AS DOUBLE), 4) AS absolute, round(n * CAST({_F0} AS DOUBLE) / 0.01, 4) AS percent, round(n * CAST({_F1} AS DOUBLE), 4) AS with_cjk FROM v"
)
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    raw = (
        F.when(k % 11 == 0, "1,234.5M").when(k % 11 == 1, F.concat(s(k % 97), F.lit(" bn"))).when(k % 11 == 2, F.concat(s(k % 89), F.lit("%"))).when(k % 11 == 3, F.concat(s(k % 5), F.lit("wan")))
        .when(k % 11 == 4, F.concat(F.lit("-"), s(k), F.lit("M"))).when(k % 11 == 5, "$1.2B").when(k % 11 == 6, "1.2.3").when(k % 11 == 7, F.concat(s(k % 50), F.lit("万"))).when(k % 11 == 8, "2.5B")
        .when(k % 11 == 9, F.concat(s(k % 31), F.lit("zz"))).otherwise(s(k))
    )
    t = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return t.select("c_custkey", "raw", finance.normalize_units(F.col("raw")).alias("absolute"), finance.normalize_units(F.col("raw"), "%").alias("percent"), finance.normalize_units(F.col("raw"), cjk_units=True).alias("with_cjk"))


_IDENTIFY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in ws) + f" THEN '{m}'" for m, ws in finance.METRIC_WORDS.items()) + " END"
_ASKED = ["What is the return on equity?", "software development cost", "Quick ratio please", "YoY revenue", "nothing here", "P/E of the firm", "net margin and roa", "EV/EBITDA"]
_ASK_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(_ASKED)) + " END || ' ' || coalesce(source, '')"


@query(f"WITH t AS (SELECT doc_id, lower({_ASK_SQL}) AS q FROM documents) SELECT doc_id, {_IDENTIFY} AS metric FROM t")
def metric_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", finance.identify_metric(F.concat(asked, F.lit(" "), F.coalesce("source", F.lit("")))).alias("metric"))
