"""The registered SQL functions against the library's own expressions, and the table function's columns."""

import pytest
from pyspark.sql import functions as F

from pagequarry import sql
from pagequarry.functions import finance, text
from pagequarry.operators import tables

TEXTS = ["| a | b |\n|---|---|\n| 1 |  |\n text \n|x|", "", None, "| Jahr | Überschuss |\n| 2024 | 1,234.5 Mio |", "no table", " 7.5% (a+b) naïve "]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, md string")


def test_scalar_functions_are_the_expressions(spark, rows):
    pairs = {
        "strip_text(md)": text.strip(F.col("md")), "count_tokens(md)": text.count_tokens(F.col("md")), "count_spaced(md)": text.count_spaced(F.col("md")),
        "md_cells(md)": tables.parse_markdown(F.col("md"), keep_empty=True), "md_rows(md)": tables.parse_markdown(F.col("md")),
    }
    for call, column in pairs.items():
        said = spark.sql(f"SELECT id, {call} AS v FROM {{rows}}", rows=rows).collect()
        assert sorted(map(str, said)) == sorted(map(str, rows.select("id", column.alias("v")).collect())), call
    numbers = spark.createDataFrame([(1.0, 2.0), (0.0, 3.0), (-1.0, 0.0), (100.0, 121.0), (None, 1.0)], "a double, b double")
    said = spark.sql("SELECT yoy_percent(b, a) AS y, cagr_percent(a, b, 2.0D) AS c, ratio_percent(a, b) AS r FROM {n}", n=numbers).collect()
    own = numbers.select(finance.yoy_percent(F.col("b"), F.col("a")).alias("y"), finance.cagr_percent(F.col("a"), F.col("b"), F.lit(2.0)).alias("c"), F.round(F.try_divide("a", "b") * 100, 4).alias("r"))
    assert sorted(map(str, said)) == sorted(map(str, own.collect()))


def test_table_functions(spark, rows):
    said = spark.sql("SELECT id, r.row_no, r.cells FROM {rows} t, LATERAL md_table(t.md) r", rows=rows)
    own = rows.select("id", F.posexplode(tables.parse_markdown(F.col("md"))).alias("row_no", "cells"))
    assert sorted(map(str, said.collect())) == sorted(map(str, own.collect()))
    made = spark.sql("SELECT * FROM markdown_columns(TABLE(SELECT * FROM {rows}) PARTITION BY (id), 'md', 'b, a, none')", rows=rows)
    assert made.columns == ["id", "row_no", "b", "a", "none"]
    assert sorted(map(tuple, made.collect()), key=str) == [(0, 0, "", "1", None), (0, 1, None, "x", None), (3, 0, None, None, None)]
    assert spark.sql("SELECT * FROM markdown_columns(TABLE(SELECT md FROM {rows}), 'md', 'Jahr')", rows=rows.where("id = 3")).first().Jahr == "2024"


@pytest.mark.parametrize("call", ["TABLE(SELECT * FROM {rows}), 'text', 'a'", "TABLE(SELECT * FROM {rows}), NULL, 'a'", "'md', 'md', 'a'"])
def test_wrong_calls_are_refused_before_they_run(spark, rows, call):
    with pytest.raises(Exception, match="markdown_columns|no column"):
        spark.sql(f"SELECT * FROM markdown_columns({call})", rows=rows)
