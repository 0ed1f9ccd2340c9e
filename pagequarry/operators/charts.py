"""Charts from the text that was read in them: axes, points, type, title, description and chunk text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import NUMBER, clean_title, count_tokens, strip

MOST_POINTS = 30
POINT = r"([A-Za-z0-9一-龥]+\s*)[:\s]+([\d,]+\.?\d*)\s*([A-Z]{2,})?"

# Words that tell a chart's type, in the order in which types are tried, and words of titles.
TYPE_WORDS = {
    "bar": ["bar", "柱状", "柱", "销售额", "revenue", "profit"],
    "line": ["line", "折线", "趋势", "trend", "growth"],
    "pie": ["pie", "饼", "比例", "占比", "share", "%"],
    "scatter": ["scatter", "散点", "correlation"],
}
TITLE_WORDS = ["figure", "fig.", "fig", "chart", "exhibit", "图", "图表", "示意图", "折线图", "柱状图", "饼图"]


def _has_any(text: Column, words: list[str]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def chart_type(text: Column) -> Column:
    low, kind = F.lower(text), None
    for name, words in TYPE_WORDS.items():
        kind = F.when(_has_any(low, words), name) if kind is None else kind.when(_has_any(low, words), name)
    return kind.otherwise("unknown")


def axis_values(text: Column) -> Column:
    """array<double> of all numbers; the value axis spans them."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double")))


def axis_unit(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\[([^\]]+)\]", 1), F.lit(""))


def points(text: Column) -> Column:
    """array<struct<label, value, unit>> of at most thirty labelled numbers."""
    part = lambda i: F.regexp_extract_all(text, F.lit(POINT), F.lit(i))
    found = F.zip_with(part(1), F.zip_with(part(2), part(3), lambda v, u: F.struct(v.alias("v"), u.alias("u"))), lambda a, x: F.struct(strip(a).alias("label"), F.replace(x["v"], F.lit(","), F.lit("")).try_cast("double").alias("value"), F.nullif(x["u"], F.lit("")).alias("unit")))
    return F.slice(F.filter(found, lambda p: p["value"].isNotNull()), 1, MOST_POINTS)


def title(text: Column, caption: Column) -> Column:
    """The first of five lines, of caption and text, that has a title's length and word; its figure number goes."""
    lines = F.transform(F.slice(F.split(F.concat(caption, F.lit("\n"), text), "\n"), 1, 5), strip)
    fit = F.filter(lines, lambda x: F.length(x).between(3, 200) & _has_any(F.lower(x), TITLE_WORDS))
    return F.coalesce(clean_title(F.get(fit, F.lit(0))), F.lit(""))


def _number(v: Column) -> Column:
    return v.cast("string")


def describe(kind: Column, name: Column, pts: Column, has_axis: Column, unit: Column) -> Column:
    """One or two clauses about a chart, by its type."""
    in_unit = F.coalesce(F.concat(F.lit(" in "), unit), F.lit(""))
    label = F.when(has_axis, "Value").otherwise("value")
    first = F.slice(pts, 1, 5)
    said = (
        F.when(kind == "bar", F.concat(F.lit("shows bars with values: "), F.array_join(F.transform(first, lambda p: F.concat(p["label"], F.lit(": "), _number(p["value"]), in_unit)), ", ")))
        .when(kind == "line", F.concat(F.lit("shows a line trend for "), label, in_unit, F.lit(" across: "), F.array_join(F.transform(first, lambda p: p["label"]), ", ")))
        .when(kind == "pie", F.concat(F.lit("shows proportional distribution: "), F.array_join(F.transform(first, lambda p: F.concat(p["label"], F.lit("="), _number(p["value"]))), ", ")))
        .otherwise(F.concat(F.lit("contains "), F.size(pts).cast("string"), F.lit(" data points for "), label, in_unit))
    )
    named = F.when(name != "", F.concat(F.lit("This "), kind, F.lit(" chart titled '"), name, F.lit("'")))
    parts = F.array_compact(F.array(named, F.when(F.size(pts) > 0, said)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ". ")).otherwise(F.concat(F.lit("This is a "), kind, F.lit(" chart.")))


def extract_charts(charts: DataFrame) -> DataFrame:
    """Charts (…, text, caption) with chart_type, title, points, low, high, unit and description."""
    text = F.coalesce("text", F.lit(""))
    values = axis_values(text)
    found = charts.withColumns({"chart_type": chart_type(text), "title": title(text, F.coalesce("caption", F.lit(""))), "points": points(text), "low": F.array_min(values), "high": F.array_max(values), "unit": F.when(F.size(values) > 0, axis_unit(text))})
    return found.withColumn("description", describe(F.col("chart_type"), F.col("title"), F.col("points"), F.col("low").isNotNull(), F.col("unit")))


def _span(low: Column, high: Column) -> Column:
    return F.concat(F.lit(" range ["), _number(low), F.lit("–"), _number(high), F.lit("]"))


def chunk_text(c: DataFrame) -> DataFrame:
    """``extract_charts`` rows (with page) and their chunk: text of the lines that apply, and its token_count."""
    unit = F.coalesce(F.concat(F.lit(" ["), F.col("unit"), F.lit("]")), F.lit(""))
    point = lambda p: F.concat(p["label"], F.lit(": "), _number(p["value"]), F.coalesce(F.concat(F.lit(" "), F.col("unit")), F.lit("")))
    line = lambda test, *x: F.when(test, F.concat(*x))
    text = F.concat_ws(
        "\n", line(F.col("title") != "", F.lit("Chart Title: "), F.col("title")), F.concat(F.lit("Chart Type: "), F.col("chart_type")), line(F.coalesce("caption", F.lit("")) != "", F.lit("Caption: "), F.col("caption")),
        F.lit("X-Axis (Category): "), line(F.col("low").isNotNull(), F.lit("Y-Axis (Value"), unit, F.lit(")"), _span(F.col("low"), F.col("high"))),
        line(F.size("points") > 0, F.lit("Data Points: "), F.array_join(F.transform("points", point), "; ")), F.concat(F.lit("Description: "), F.col("description")), F.concat(F.lit("Source: page "), F.col("page").cast("string")),
    )
    return c.withColumn("chunk", text).withColumn("token_count", count_tokens(F.col("chunk")))


def index_text(c: DataFrame) -> DataFrame:
    """The extractor's own rendering of a chart, with at most twenty points."""
    unit = F.coalesce(F.concat(F.lit(" "), F.col("unit")), F.lit(""))
    line = lambda test, *x: F.when(test, F.concat(*x))
    bracket = F.coalesce(F.concat(F.lit(" ["), F.col("unit"), F.lit("]")), F.lit(""))
    text = F.concat_ws(
        "\n", line(F.col("title") != "", F.lit("Chart Title: "), F.col("title")), line(F.coalesce("caption", F.lit("")) != "", F.lit("Caption: "), F.col("caption")), F.concat(F.lit("Chart Type: "), F.col("chart_type")),
        F.lit("X-Axis (Category): "), line(F.col("low").isNotNull(), F.lit("Y-Axis (Value"), bracket, F.lit("): ("), _number(F.col("low")), F.lit(", "), _number(F.col("high")), F.lit(")")),
        line(F.size("points") > 0, F.lit("Data Points: "), F.array_join(F.transform(F.slice("points", 1, 20), lambda p: F.concat(p["label"], F.lit("="), _number(p["value"]), unit)), "; ")), F.concat(F.lit("Description: "), F.col("description")),
    )
    return c.withColumn("index_text", text)
