"""Ratio report: yearly statements of companies, their ratios, growth and rank.

    python -m jobs.ratio_report --config jobs/ratio_report.json [--set tables=DIR output=DIR first_year=1995 last_year=1996]

Input: the tables lineitem, orders, customer and nation under ``tables``, of which only the orders of the wanted years, and of the year
before them for growth, are read. A statement belongs to a company (nation) and a fiscal year.

Output: a Parquet table partitioned by fiscal year: company, metric, value, unit, error, prior_value, growth_percent, rank (by value,
the largest first, equal values together), n_companies. The years of a run replace their own partitions, and no others; a rerun leaves the same rows.

Defined results: a ratio that can't be computed is null with its error, and has no rank; growth is null in a company's first year, or
where the year before it is missing or its value is zero or null; a year without orders has no partition.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line
from pagequarry.functions import finance
from pagequarry.plans.catalog import statements

log = logging.getLogger("jobs.ratio_report")

TABLES = ["lineitem", "orders", "customer", "nation"]
#: The ratios whose variables a yearly statement holds.
METRICS = [m for m in finance.RATIO_METRICS if m not in ("yoy_growth", "cagr")]
REPORT = "company string, metric string, value double, unit string, error string, prior_value double, growth_percent double, rank int, n_companies long, fy int"


@dataclass(frozen=True)
class Settings:
    tables: str
    output: str
    first_year: int | None = None
    last_year: int | None = None
    metrics: list[str] = field(default_factory=lambda: list(METRICS))


@dataclass(frozen=True)
class Report:
    rows_read: dict[str, int]
    rows_written: dict[int, int]


def metric_rows(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(company, fy, metric, value, unit, error), a row for each metric of each statement."""
    if odd := sorted(set(metrics) - set(METRICS)):
        raise ValueError(f"unknown metrics: {', '.join(odd)}")
    long = rows.select("company", "fy", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), finance.ratio(m, F.col).alias("value")) for m in metrics))).alias("m")).select("company", "fy", "m.*")
    known = F.col("value").isNotNull()
    return long.withColumns({"unit": F.when(known, finance.ratio_unit(F.col("metric"))), "error": F.when(~known, "not computable")})


def with_growth(rows: DataFrame) -> DataFrame:
    """``rows`` with the value of the year before and the growth against it."""
    by_year = Window.partitionBy("company", "metric").orderBy("fy")
    prior = F.when(F.lag("fy").over(by_year) == F.col("fy") - 1, F.lag("value").over(by_year))
    return rows.withColumn("prior_value", prior).withColumn("growth_percent", finance.yoy_percent(F.col("value"), F.col("prior_value")))


def with_rank(rows: DataFrame) -> DataFrame:
    """``rows`` with the rank of a company's value in its year, and how many companies have one."""
    of_year = Window.partitionBy("fy", "metric")
    place = F.rank().over(of_year.orderBy(F.desc_nulls_last("value")))
    return rows.withColumns({"rank": F.when(F.col("value").isNotNull(), place), "n_companies": F.count("value").over(of_year)})


def written(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


def run(spark: SparkSession, settings: Settings) -> Report:
    """Compute the wanted years' ratios and replace these years in the output."""
    first, last = settings.first_year, settings.last_year
    read = {name: spark.read.parquet(f"{settings.tables}/{name}.parquet").count() for name in TABLES}  # from the files' footers
    log.info("reading %s of %s", ", ".join(f"{name}: {n} rows" for name, n in read.items()), settings.tables)
    rows = statements(spark, settings.tables, first - 1 if first is not None else None, last)
    made = with_rank(with_growth(metric_rows(rows, settings.metrics)))
    if first is not None:
        made = made.where(F.col("fy") >= first)  # the year before is for growth alone
    made = made.select(*(c.split()[0] for c in REPORT.split(", ")))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fy").parquet(settings.output)
    of_run = written(spark, settings.output)
    of_run = of_run.where(F.col("fy") >= first) if first is not None else of_run
    of_run = of_run.where(F.col("fy") <= last) if last is not None else of_run
    counts = {r.fy: r["count"] for r in of_run.groupBy("fy").count().orderBy("fy").collect()}
    log.info("wrote %s to %s", ", ".join(f"{y}: {n} rows" for y, n in counts.items()) or "nothing", settings.output)
    return Report(read, counts)


if __name__ == "__main__":
    sys.exit(command_line(Settings, run, "ratio_report"))
