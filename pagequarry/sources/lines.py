"""Lines of text files with their positions: the number that a reader of the files, one after the other, would count to.

A text scan keeps the order of lines inside each split of a file, and knows the file and where the split begins. Lines of each split are
counted in a first pass; the sums of these counts, one number for each split, give the number of each split's first line; a second
pass adds the place inside the split. Nothing is sorted and no task sees more than its splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str], separator: str = "\n", kept: Column | None = None) -> DataFrame:
    """(file, line, line_in_file, text) of the lines where ``kept`` (a condition on ``text``) holds, numbered from 0.

    Files count in the order of their paths, so that the parts of a sorted table that Spark has written follow one another. The
    files must not change while the result is in use.
    """
    rows = spark.read.option("lineSep", separator).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    if kept is not None:
        rows = rows.where(kept)
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "start").agg(F.min("at").alias("least"), F.count("*").alias("n")).collect()
    total, of_file, firsts = 0, {}, []
    for s in sorted(splits):
        firsts.append((s.file, s.start, total - s.least, of_file.get(s.file, 0) - s.least))
        total += s.n
        of_file[s.file] = of_file.get(s.file, 0) + s.n
    first = spark.createDataFrame(firsts, "file string, start long, shift long, file_shift long")
    return placed.join(first, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line"), (F.col("at") + F.col("file_shift")).alias("line_in_file"), "text")


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """``schema``'s columns and ``line`` of files of JSON objects, a line each; blank lines don't count, one that can't be read has nulls."""
    rows = numbered_lines(spark, path, kept=F.trim("text") != "")
    return rows.select("line", F.from_json("text", schema).alias("r")).select("line", "r.*")
