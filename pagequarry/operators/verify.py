"""Citations and numbers of answers, held against their evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import text as t


def cited(answers: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """(key, pos, doc, page) of every citation mark."""
    return answers.select(key, F.posexplode(t.citations(F.coalesce(F.col(answer), F.lit("")))).alias("pos", "c")).select(key, "pos", "c.doc", "c.page")


def valid_citations(citations: DataFrame, evidence: DataFrame, key: str = "answer_id") -> DataFrame:
    """Citations of a (doc, page) that is in the answer's evidence (key, doc, page)."""
    return citations.join(evidence.select(key, "doc", F.col("page").cast("int").alias("page")), [key, "doc", "page"], "left_semi")


def hallucinated_citations(citations: DataFrame, evidence: DataFrame, key: str = "answer_id") -> DataFrame:
    """Citations of what the answer's evidence doesn't have."""
    return citations.join(evidence.select(key, "doc", F.col("page").cast("int").alias("page")), [key, "doc", "page"], "left_anti")


def verify_citations(answers: DataFrame, evidence: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """(key, n_found, n_valid, verified, groundedness, issues). Without citations: verified, and no groundedness."""
    marks = cited(answers, key, answer)
    known = evidence.select(key, "doc", F.col("page").cast("int").alias("page"), F.lit(True).alias("_known")).distinct()
    judged = marks.join(known, [key, "doc", "page"], "left")
    issue = F.when(F.col("_known").isNull(), F.struct("pos", F.concat_ws(":", "doc", F.col("page").cast("string")).alias("at")))
    counts = judged.groupBy(key).agg(F.count("*").alias("f"), F.count("_known").alias("v"), F.array_sort(F.collect_list(issue)).alias("i"))
    n = F.coalesce("f", F.lit(0))
    return answers.select(key).join(counts, key, "left").select(
        key, n.alias("n_found"), F.when(n > 0, F.col("v")).alias("n_valid"), (n == F.coalesce("v", F.lit(0))).alias("verified"),
        F.round(F.try_divide(F.col("v").cast("double"), n.cast("double")), 4).alias("groundedness"), F.coalesce(F.array_join("i.at", ","), F.lit("")).alias("issues"),
    )


def missing_data(answer: Column, evidence: Column) -> tuple[Column, Column, Column, Column]:
    """(missing numbers, years, percents, alert level): what the answer states and its evidence doesn't contain."""
    absent = lambda values, clean: F.filter(F.array_distinct(values), lambda x: ~evidence.contains(clean(x)))
    numbers = absent(t.numbers(answer), lambda x: F.replace(x, F.lit(","), F.lit("")))
    years = absent(t.years(answer), lambda x: x)
    percents = absent(t.percents(answer), lambda x: F.rtrim(x, F.lit("%")))
    level = F.when((F.size(years) > 0) | (F.size(numbers) > 2), "HIGH").when((F.size(numbers) > 0) | (F.size(percents) > 0), "MEDIUM").otherwise("NONE")
    return numbers, years, percents, level


def evidence_check_default(evidence: Column) -> tuple[Column, Column]:
    """(verdict, confidence) where no model judges: sure without evidence, unsure with some."""
    return F.lit("INSUFFICIENT"), F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, 0.0).otherwise(1.0)


Model = Callable[[Column], Column]

_CHECK = "verdict string, confidence double, reasoning string, gaps array<string>, suggested_tools array<string>"
_AUDIT = "groundedness_score double, num_claims int, claims array<struct<claim: string, supported: boolean>>"


def evidence_check(question: Column, evidence: Column, judge: Model | None = None) -> Column:
    """struct<verdict, confidence, reasoning, gaps, suggested_tools> of a question and its evidence texts (an array).

    ``judge`` turns a prompt into a model's reply, which holds a JSON object. No evidence is surely insufficient; without a model, or
    with a reply that can't be read, evidence is insufficient at confidence 0.
    """
    said = lambda confidence, reason, gap, tool=None: F.struct(
        F.lit("INSUFFICIENT").alias("verdict"), F.lit(confidence).alias("confidence"), reason.alias("reasoning"), F.array(F.lit(gap)).alias("gaps"),
        (F.array(F.lit(tool)) if tool else F.array().cast("array<string>")).alias("suggested_tools"),
    )
    empty = F.coalesce(F.size(evidence), F.lit(0)) <= 0
    none = said(1.0, F.lit("There is no evidence."), "nothing was retrieved", "retrieval_hybrid_search")
    if judge is None:
        return F.when(empty, none).otherwise(said(0.0, F.lit("No model judges."), "no judging model is set"))
    numbered = F.array_join(F.transform(F.slice(evidence, 1, 10), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x, 1, 500))), "\n\n")
    prompt = F.concat(F.lit("Does the evidence suffice to answer? Reply with a JSON object of verdict, confidence, reasoning, gaps, suggested_tools.\n\nQuestion: "), question, F.lit("\n\n"), numbered)
    reply = judge(prompt)
    parsed = F.from_json(t.json_in_text(reply), _CHECK)
    unread = said(0.0, F.substring(reply, 1, 200), "the reply can't be read")
    return F.when(empty, none).when(parsed["verdict"].isNotNull(), parsed).otherwise(unread)


def answer_groundedness(question: Column, answer: Column, evidence: Column, audit: Model | None = None) -> Column:
    """struct<groundedness_score, num_claims, claims, error> of an answer and its evidence texts; 0 with an error without a model."""
    failed = lambda why: F.struct(
        F.lit(0.0).alias("groundedness_score"), F.lit(0).alias("num_claims"), F.array().cast("array<struct<claim: string, supported: boolean>>").alias("claims"), F.lit(why).alias("error")
    )
    if audit is None:
        return failed("no auditing model is set")
    numbered = F.array_join(F.transform(F.slice(evidence, 1, 8), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x, 1, 400))), "\n\n")
    ask = "Which claims of the answer does the evidence support? Reply with a JSON object of groundedness_score, num_claims, claims.\n\nQuestion: "
    parsed = F.from_json(t.json_in_text(audit(F.concat(F.lit(ask), question, F.lit("\n\nAnswer: "), answer, F.lit("\n\n"), numbered))), _AUDIT)
    found = F.struct(*(parsed[c].alias(c) for c in ("groundedness_score", "num_claims", "claims")), F.lit(None).cast("string").alias("error"))
    return F.when(parsed["groundedness_score"].isNotNull(), found).otherwise(failed("the reply can't be read"))


def pack_evidence(chunks: DataFrame, key: str, most: int = 10, chars: int = 500) -> DataFrame:
    """(key, evidence): the first chunks (key, rank, doc, page, text) of each question as a prompt's evidence block."""
    line = F.concat(F.lit("[Source: "), F.col("doc"), F.lit(", page "), F.col("page").cast("string"), F.lit("]\n"), F.substring("text", 1, chars))
    top = chunks.where(F.col("rank") <= most).select(key, "rank", line.alias("line"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("evidence"))


def first_citations(citations: DataFrame, key: str = "answer_id") -> DataFrame:
    """Each (doc, page) of an answer once, where it is cited first."""
    first = Window.partitionBy(key, "doc", "page").orderBy("pos")
    return citations.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
