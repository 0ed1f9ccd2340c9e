"""Queries of page regions and charts. Regions are made from orders by integer arithmetic, charts' text from orders' fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import geometry as g
from pagequarry.operators import charts as c
from pagequarry.operators import layout
from pagequarry.plans.catalog import query, table

REGIONS_SQL = """
reg AS (SELECT o_orderkey // 400 AS doc, (o_orderkey % 400) // 8 AS page, o_orderkey AS region,
  CASE o_orderkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'chart' WHEN 3 THEN 'table' WHEN 4 THEN 'text' ELSE 'header' END AS label,
  CAST(CASE WHEN o_orderkey % 6 = 5 THEN 0 ELSE (o_orderkey % 5) * 10 END AS DOUBLE) AS x1, CAST(CASE WHEN o_orderkey % 6 = 5 THEN 0 ELSE (o_orderkey % 7) * 12 END AS DOUBLE) AS y1,
  CAST(CASE WHEN o_orderkey % 6 = 5 THEN 90 ELSE (o_orderkey % 5) * 10 + 40 + o_custkey % 3 END AS DOUBLE) AS x2, CAST(CASE WHEN o_orderkey % 6 = 5 THEN 99 ELSE (o_orderkey % 7) * 12 + 14 + o_custkey % 20 END AS DOUBLE) AS y2,
  100.0::DOUBLE AS page_height, 'cap ' || o_orderpriority AS text FROM orders)
"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 6 == 0, "text").when(k % 6 == 1, "table").when(k % 6 == 2, "chart").when(k % 6 == 3, "table").when(k % 6 == 4, "text").otherwise("header")
    x, y = (k % 5) * 10, (k % 7) * 12
    side = lambda whole, part, name: F.when(k % 6 == 5, whole).otherwise(part).cast("double").alias(name)  # noqa: E731  a header spans the page
    box = F.struct(side(0, x, "x1"), side(0, y, "y1"), side(90, x + 40 + u % 3, "x2"), side(99, y + 14 + u % 20, "y2"))
    return table(spark, sf_dir, "orders").select(
        F.floor(k / 400).alias("doc"), F.floor(k % 400 / 8).alias("page"), k.alias("region"), kind.alias("label"), box.alias("box"), F.lit(100.0).alias("page_height"), F.concat(F.lit("cap "), F.col("o_orderpriority")).alias("text")
    )


@query(f"WITH {REGIONS_SQL} SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(region) AS BIGINT) AS keys FROM reg WHERE label IN ('table', 'chart') GROUP BY 1")
def layout_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.regions_of(regions(spark, sf_dir), "table", "chart").groupBy("label").agg(F.count("*").alias("n"), F.sum("region").alias("keys"))


@query(f"WITH {REGIONS_SQL} SELECT region, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y1 < 5 OR y2 > page_height - 5 AS at_edge FROM reg")
def bbox_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    cx, cy = g.centre(b)
    return regions(spark, sf_dir).select("region", g.width(b).alias("width"), g.height(b).alias("height"), g.area(b).alias("area"), cx.alias("cx"), cy.alias("cy"), g.touches_edge(b, F.col("page_height")).alias("at_edge"))


_PAIRS = f"""{REGIONS_SQL}, pr AS (SELECT a.doc, a.page, a.region AS a, b.region AS b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s, a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2 AS c FROM reg a JOIN reg b ON a.doc = b.doc AND a.page = b.page AND a.region < b.region)"""


@query(f"WITH {_PAIRS} SELECT doc, page, a, b, round(i / (s - i), 4) AS iou FROM pr WHERE i > 0")
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlapping(regions(spark, sf_dir)).where("iou > 0").drop("a_contains_b")


@query(f"WITH {_PAIRS} SELECT doc, page, a, b FROM pr WHERE c")
def bbox_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlapping(regions(spark, sf_dir)).where("a_contains_b").drop("iou", "a_contains_b")


@query(f"WITH {REGIONS_SQL} SELECT doc, page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM reg GROUP BY 1, 2")
def bbox_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merge_boxes(regions(spark, sf_dir), "doc", "page")


@query(f"WITH {REGIONS_SQL}, t AS (SELECT * FROM reg WHERE label = 'table'), j AS (SELECT a.doc, a.page, a.region, b.region AS next_region, row_number() OVER (PARTITION BY a.region ORDER BY b.region) AS n FROM t a JOIN t b ON a.doc = b.doc AND b.page = a.page + 1 "
       "WHERE (a.y1 < 5 OR a.y2 > a.page_height - 5) AND b.y1 <= 5 AND abs((a.x2 - a.x1) - (b.x2 - b.x1)) / greatest(a.x2 - a.x1, 1) < 0.1) SELECT doc, page, region, next_region FROM j WHERE n = 1")  # fmt: skip
def cross_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cross_page_pairs(regions(spark, sf_dir))


_DETECTED = f"""{REGIONS_SQL}, det AS (SELECT doc, page, region, label, x1, y1, x2, y2, (region * 7 + doc) % 20 / 20.0::DOUBLE AS confidence FROM reg)"""
_IOU = """list_aggregate(list_transform(s.kept, lambda k: greatest(0.0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0.0, least(k.y2, o.y2) - greatest(k.y1, o.y1)) /
  ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0.0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0.0, least(k.y2, o.y2) - greatest(k.y1, o.y1)))), 'max')"""


@query(f"WITH RECURSIVE {_DETECTED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc, page, label ORDER BY confidence DESC, region) AS n FROM det WHERE confidence >= 0.5), "
       "s AS (SELECT doc, page, label, 1 AS n, [{'r': region, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM o WHERE n = 1 UNION ALL "
       "SELECT o.doc, o.page, o.label, s.n + 1, CASE WHEN {iou} > 0.4 THEN s.kept ELSE list_append(s.kept, {'r': o.region, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}) END FROM s JOIN o ON o.doc = s.doc AND o.page = s.page AND o.label = s.label AND o.n = s.n + 1), "
       "f AS (SELECT doc, page, label, unnest(arg_max(kept, n)).r AS region FROM s GROUP BY 1, 2, 3) SELECT doc, page, label, region, confidence FROM f JOIN det USING (doc, page, label, region)".replace("{iou}", _IOU))  # fmt: skip
def layout_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections after the cut by confidence and the suppression of those that a surer one overlaps."""
    sure = (F.col("region") * 7 + F.col("doc")) % 20 / 20.0
    return layout.suppress(regions(spark, sf_dir).withColumn("confidence", sure)).select("doc", "page", "label", "region", "confidence")


_EDGED = """
edged AS (SELECT o_orderkey // 400 AS doc, (o_orderkey % 400) // 8 AS page, o_orderkey AS region, CASE WHEN o_orderkey % 3 = 0 THEN 30.0 ELSE 2.0 END AS y1,
  CASE WHEN o_custkey % 4 = 0 THEN 60.0 ELSE 98.0 END AS y2, CASE WHEN o_custkey % 5 = 0 THEN 50.0 ELSE 40.0 + 20 * (o_orderkey % 2) + o_custkey % 3 END AS x2 FROM orders WHERE o_orderkey % 8 IN (1, 4, 5))"""


def _edged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables a page, most of them from its upper to its lower edge, in widths that let them go on in one another."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    wide = F.when(u % 5 == 0, 50.0).otherwise(40.0 + 20 * (k % 2) + u % 3)
    box = F.struct(F.lit(0.0).alias("x1"), F.when(k % 3 == 0, 30.0).otherwise(2.0).alias("y1"), wide.alias("x2"), F.when(u % 4 == 0, 60.0).otherwise(98.0).alias("y2"))
    rows = table(spark, sf_dir, "orders").where((k % 8).isin(1, 4, 5))
    return rows.select(F.floor(k / 400).alias("doc"), F.floor(k % 400 / 8).alias("page"), k.alias("region"), F.lit("table").alias("label"), box.alias("box"), F.lit(100.0).alias("page_height"))


@query(f"WITH RECURSIVE {_EDGED}, one AS (SELECT a.doc, a.page, a.region, min(b.region) AS next_region FROM edged a JOIN edged b ON a.doc = b.doc AND b.page = a.page + 1 "
       "WHERE a.y2 > 95 AND b.y1 <= 5 AND abs(a.x2 - b.x2) / greatest(a.x2, 1) < 0.1 GROUP BY 1, 2, 3), link AS (SELECT doc, page, next_region, min(region) AS region FROM one GROUP BY 1, 2, 3), "
       "ch AS (SELECT doc, page, region, page AS chain_page, region AS chain_region, 0 AS fragment FROM edged WHERE region NOT IN (SELECT next_region FROM link) "
       "UNION ALL SELECT ch.doc, ch.page + 1, link.next_region, chain_page, chain_region, fragment + 1 FROM ch JOIN link ON link.doc = ch.doc AND link.page = ch.page AND link.region = ch.region) "
       "SELECT *, CAST(count(*) OVER (PARTITION BY doc, chain_page, chain_region) AS INTEGER) AS n_fragments FROM ch")  # fmt: skip
def table_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that go on over pages, followed from page to page."""
    return layout.table_chains(_edged(spark, sf_dir))


@query(f"WITH {REGIONS_SQL}, j AS (SELECT a.region, b.text, row_number() OVER (PARTITION BY a.region ORDER BY b.y2 DESC, b.region) AS n FROM reg a JOIN reg b ON a.doc = b.doc AND a.page = b.page WHERE a.label = 'chart' AND b.label = 'text' AND b.y2 > greatest(0.0, a.y1 - 20) AND b.y2 < a.y1) "
       "SELECT doc, page, reg.region, coalesce(j.text, '') AS caption FROM reg LEFT JOIN j ON j.region = reg.region AND n = 1 WHERE label = 'chart'")  # fmt: skip
def chart_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.captions(regions(spark, sf_dir))


# --- charts ----------------------------------------------------------------------------------------------------------

_CHART_TEXT = (
    "CASE o_orderkey % 5 WHEN 0 THEN 'Figure ' || (o_orderkey % 9) || ': Revenue by year' || chr(10) WHEN 1 THEN 'growth chart' || chr(10) WHEN 2 THEN 'market share' || chr(10) WHEN 3 THEN 'plain' || chr(10) ELSE 'scatter' || chr(10) END || "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'no numbers' ELSE 'North: ' || (o_custkey % 500) || ' USD' || chr(10) || 'South: 1,' || (100 + o_orderkey % 900) || chr(10) || 'West ' || (o_orderkey % 90) || '.5 [B USD]' END"
)
CHARTS_SQL = f"ct AS (SELECT o_orderkey AS chart_id, {_CHART_TEXT} AS text, CASE WHEN o_orderkey % 4 = 0 THEN 'Exhibit ' || (o_orderkey % 6) || '. Cap' ELSE '' END AS caption, 1 + o_orderkey % 50 AS page FROM orders)"


def chart_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    head = F.when(k % 5 == 0, F.concat(F.lit("Figure "), s(k % 9), F.lit(": Revenue by year\n"))).when(k % 5 == 1, "growth chart\n").when(k % 5 == 2, "market share\n").when(k % 5 == 3, "plain\n").otherwise("scatter\n")
    rows = F.concat(F.lit("North: "), s(u % 500), F.lit(" USD\nSouth: 1,"), s(100 + k % 900), F.lit("\nWest "), s(k % 90), F.lit(".5 [B USD]"))
    caption = F.when(k % 4 == 0, F.concat(F.lit("Exhibit "), s(k % 6), F.lit(". Cap"))).otherwise("")
    return table(spark, sf_dir, "orders").select(k.alias("chart_id"), F.concat(head, F.when(k % 7 == 0, "no numbers").otherwise(rows)).alias("text"), caption.alias("caption"), (1 + k % 50).alias("page"))


_TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in c.TYPE_WORDS.items()) + " ELSE 'unknown' END"
_TITLE_WORD = " OR ".join(f"contains(lower(x), '{w}')" for w in c.TITLE_WORDS)
_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TITLE_SQL = (
    f"coalesce({_S.format(r"regexp_replace(list_filter(list_transform(string_split(caption || chr(10) || text, chr(10))[1:5], lambda x: " + _S.format('x') + f"), lambda x: len(x) BETWEEN 3 AND 200 AND ({_TITLE_WORD}))[1], '(?i)^(figure|fig\\.|fig|chart|exhibit)\\s*\\d*[:.\\s]*', '')")}, '')"
)
_NUM_SQL = r"list_filter(list_transform(regexp_extract_all(text, '\b[\d,]+\.?\d*\b'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)"
_PT = c.POINT.replace("一-龥", r"\x{4e00}-\x{9fa5}")
_PTS_SQL = (
    f"list_filter(list_transform(range(1, len(regexp_extract_all(text, '{_PT}', 1)) + 1), lambda i: struct_pack(label := {_S.format(f"regexp_extract_all(text, '{_PT}', 1)[i]")}, "
    f"value := TRY_CAST(replace(regexp_extract_all(text, '{_PT}', 2)[i], ',', '') AS DOUBLE), unit := nullif(regexp_extract_all(text, '{_PT}', 3)[i], ''))), lambda p: p.value IS NOT NULL)[1:30]"
)
_EX = f"""{CHARTS_SQL}, ex AS (SELECT chart_id, text, caption, page, {_TYPE_SQL} AS chart_type, {_TITLE_SQL} AS title, {_PTS_SQL} AS points, {_NUM_SQL} AS vs FROM ct),
ax AS (SELECT *, list_min(vs) AS low, list_max(vs) AS high, CASE WHEN len(vs) > 0 THEN nullif(regexp_extract(text, '\\[([^\\]]+)\\]', 1), '') END AS unit FROM ex),
de AS (SELECT *, coalesce(' in ' || unit, '') AS iu, CASE WHEN low IS NULL THEN 'value' ELSE 'Value' END AS yl FROM ax),
ds AS (SELECT *, CASE WHEN title = '' AND len(points) = 0 THEN 'This is a ' || chart_type || ' chart.' ELSE array_to_string(list_filter([CASE WHEN title <> '' THEN 'This ' || chart_type || ' chart titled ''' || title || '''' END,
  CASE WHEN len(points) > 0 THEN CASE chart_type WHEN 'bar' THEN 'shows bars with values: ' || array_to_string(list_transform(points[1:5], lambda p: p.label || ': ' || p.value || iu), ', ')
    WHEN 'line' THEN 'shows a line trend for ' || yl || iu || ' across: ' || array_to_string(list_transform(points[1:5], lambda p: p.label), ', ')
    WHEN 'pie' THEN 'shows proportional distribution: ' || array_to_string(list_transform(points[1:5], lambda p: p.label || '=' || p.value), ', ')
    ELSE 'contains ' || len(points) || ' data points for ' || yl || iu END END], lambda x: x IS NOT NULL), '. ') END AS description FROM de),
ch AS (SELECT *, array_to_string(list_filter([CASE WHEN title <> '' THEN 'Chart Title: ' || title END, 'Chart Type: ' || chart_type, CASE WHEN caption <> '' THEN 'Caption: ' || caption END, 'X-Axis (Category): ',
  CASE WHEN low IS NOT NULL THEN 'Y-Axis (Value' || coalesce(' [' || unit || ']', '') || ') range [' || low || '–' || high || ']' END, CASE WHEN len(points) > 0 THEN 'Data Points: ' || array_to_string(list_transform(points, lambda p: p.label || ': ' || p.value || coalesce(' ' || unit, '')), '; ') END,
  'Description: ' || description, 'Source: page ' || page], lambda x: x IS NOT NULL), chr(10)) AS chunk,
  array_to_string(list_filter([CASE WHEN title <> '' THEN 'Chart Title: ' || title END, CASE WHEN caption <> '' THEN 'Caption: ' || caption END, 'Chart Type: ' || chart_type, 'X-Axis (Category): ',
  CASE WHEN low IS NOT NULL THEN 'Y-Axis (Value' || coalesce(' [' || unit || ']', '') || '): (' || low || ', ' || high || ')' END, CASE WHEN len(points) > 0 THEN 'Data Points: ' || array_to_string(list_transform(points[1:20], lambda p: p.label || '=' || p.value || coalesce(' ' || unit, '')), '; ') END,
  'Description: ' || description], lambda x: x IS NOT NULL), chr(10)) AS index_text FROM ds)
"""


@query(f"WITH {CHARTS_SQL} SELECT chart_id, {_TYPE_SQL} AS chart_type FROM ct")
def chart_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_texts(spark, sf_dir).select("chart_id", c.chart_type(F.col("text")).alias("chart_type"))


@query(f"WITH {CHARTS_SQL} SELECT chart_id, {_TITLE_SQL} AS title FROM ct")
def chart_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_texts(spark, sf_dir).select("chart_id", c.title(F.col("text"), F.col("caption")).alias("title"))


@query(f"WITH {_EX} SELECT chart_id, low, high, unit, CAST(len(vs) AS INTEGER) AS n_values FROM ax")
def chart_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = c.axis_values(F.col("text"))
    return chart_texts(spark, sf_dir).select("chart_id", F.array_min(values).alias("low"), F.array_max(values).alias("high"), F.when(F.size(values) > 0, c.axis_unit(F.col("text"))).alias("unit"), F.size(values).alias("n_values"))


@query(f"WITH {_EX}, p AS (SELECT chart_id, unnest(points) AS p FROM ex) SELECT chart_id, p.label AS label, p.value AS value, p.unit AS unit FROM p")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_texts(spark, sf_dir).select("chart_id", F.explode(c.points(F.col("text"))).alias("p")).select("chart_id", "p.label", "p.value", "p.unit")


@query(f"WITH {_EX} SELECT chart_id, description FROM ds")
def chart_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.extract_charts(chart_texts(spark, sf_dir)).select("chart_id", "description")


@query(f"WITH {_EX} SELECT chart_id, chart_type, title, caption, description, CAST(len(points) AS INTEGER) AS n_points, low, high, unit FROM ds")
def chart_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.extract_charts(chart_texts(spark, sf_dir)).select("chart_id", "chart_type", "title", "caption", "description", F.size("points").alias("n_points"), "low", "high", "unit")


@query(f"WITH {_EX} SELECT chart_id, chunk, CAST(len(regexp_extract_all(chunk, '[\\p{{L}}\\p{{N}}_.+%-]+')) AS INTEGER) AS token_count FROM ch")
def chart_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_text(c.extract_charts(chart_texts(spark, sf_dir))).select("chart_id", "chunk", "token_count")


@query(f"WITH {_EX} SELECT chart_id, index_text FROM ch")
def chart_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.index_text(c.extract_charts(chart_texts(spark, sf_dir))).select("chart_id", "index_text")
