"""Faithfulness of answers: a score for each, and a report over many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import search_terms


def faithfulness(question: Column, answer: Column, contexts: Column, metric: Callable[[Column, Column, Column], Column] | None = None) -> Column:
    """struct<faithfulness, error>: the score of a model's metric, 0 with an error where it gives none; without one, the proxy."""
    score = metric(question, answer, contexts) if metric else faithfulness_proxy(answer, contexts)
    error = F.when(score.isNull(), "the metric gave no score")
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("faithfulness"), error.alias("error"))


def faithfulness_proxy(answer: Column, contexts: Column, least: float = 0.5) -> Column:
    """The share of an answer's sentences whose terms are covered by the contexts to ``least`` or more.

    A stand-in that needs no model, not the model's own metric.
    """
    known = F.array_distinct(search_terms(contexts))
    sentences = F.filter(F.transform(F.split(answer, r"[.!?。！？]+(?:\s+|$)"), lambda s: search_terms(s)), lambda s: F.size(s) > 0)
    covered = F.filter(sentences, lambda s: F.size(F.array_intersect(F.array_distinct(s), known)) >= least * F.size(F.array_distinct(s)))
    return F.coalesce(F.round(F.try_divide(F.size(covered).cast("double"), F.size(sentences).cast("double")), 4), F.lit(0.0))


def report(results: DataFrame, *groups: str) -> DataFrame:
    """Mean, median and sample deviation of scores (faithfulness, error); rows with an error count apart."""
    ok = F.when(F.col("error").isNull(), F.col("faithfulness"))
    return results.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.round(F.avg(ok), 4).alias("mean"),
        F.round(F.percentile(ok, F.lit(0.5)), 4).alias("median"), F.round(F.coalesce(F.stddev_samp(ok), F.lit(0.0)), 4).alias("stdev"),
    )


def histogram(results: DataFrame, *groups: str) -> DataFrame:
    """How many scores lie in each grading band; failures apart."""
    s, ok = F.col("faithfulness"), F.col("error").isNull()
    return results.groupBy(*groups).agg(
        F.count_if(ok & (s >= 0.9)).alias("excellent"), F.count_if(ok & (s >= 0.7) & (s < 0.9)).alias("good"), F.count_if(ok & (s >= 0.5) & (s < 0.7)).alias("fair"),
        F.count_if(ok & (s < 0.5)).alias("poor"), F.count_if(~ok).alias("failed"),
    )
