"""Conversation memory inside a token budget: turns (conv_id, turn, role, text).

Tokens are counted by the chunkers' pattern, as no vocabulary of the original counter is at hand; pass another counter where
one is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import count_tokens, first_fifth

SUMMARY_HEAD = "[Prior conversation summary — do not assume any details not mentioned here]\n"


@dataclass(frozen=True)
class Budget:
    tokens: int = 8192
    keep: int = 4
    soft_ratio: float = 0.85

    @property
    def soft(self) -> int:
        return int(self.tokens * self.soft_ratio)


def with_tokens(turns: DataFrame, counter=count_tokens) -> DataFrame:
    """Turns with token_count and is_summary where they lack them."""
    if "token_count" not in turns.columns:
        turns = turns.withColumn("token_count", counter(F.coalesce("text", F.lit(""))).cast("long"))
    return turns if "is_summary" in turns.columns else turns.withColumn("is_summary", F.lit(False))


def totals(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(conv_id, total_tokens, over, near): summaries don't count towards the total."""
    total = F.coalesce(F.sum(F.when(~F.col("is_summary"), F.col("token_count"))), F.lit(0))
    return with_tokens(turns).groupBy("conv_id").agg(total.alias("total_tokens")).withColumns({"over": F.col("total_tokens") >= budget.tokens, "near": F.col("total_tokens") >= budget.soft})


def message_tokens(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens): every message costs four tokens besides its own."""
    return with_tokens(turns).groupBy("conv_id").agg(F.sum(F.col("token_count") + 4).alias("tokens"))


def _ordered(turns: DataFrame, *columns: str) -> DataFrame:
    """One row a conversation, its turns in order; a conversation's own size bounds it."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", *columns))).alias("t"))


def fits(counts: Column, budget: int) -> Column:
    """array<boolean>: which turns enter a context, oldest first; a turn that is too large is passed over."""
    kind = "struct<total:bigint,took:array<boolean>>"
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<boolean>").alias("took")).cast(kind)

    def step(s: Column, n: Column) -> Column:
        ok = s["total"] + n <= budget
        return F.struct((s["total"] + F.when(ok, n).otherwise(0)).alias("total"), F.concat(s["took"], F.array(ok)).alias("took")).cast(kind)

    return F.aggregate(counts, start, step, lambda s: s["took"])


def context(turns: DataFrame, budget: int = 8192, query_tokens: int = 0) -> DataFrame:
    """(conv_id, turn, role, text, token_count) of the turns that enter a prompt's context."""
    whole = _ordered(with_tokens(turns), "role", "text", "token_count")
    took = fits(F.transform("t", lambda x: x["token_count"]), budget - query_tokens)
    rows = whole.select("conv_id", F.explode(F.filter(F.zip_with("t", took, lambda x, ok: F.struct(x.alias("x"), ok.alias("ok"))), lambda z: z["ok"])).alias("z"))
    return rows.select("conv_id", "z.x.*")


def history_tail(turns: DataFrame, last: int = 10) -> DataFrame:
    """The newest turns of each conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")


def full_history(turns: DataFrame) -> DataFrame:
    """All turns of each conversation in order."""
    return turns.orderBy("conv_id", "turn")


def last_summary(turns: DataFrame) -> DataFrame:
    """(conv_id, summary): the newest summary turn's text, without its head, of turns that ``truncate`` gave."""
    newest = turns.where("is_summary").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return newest.select("conv_id", F.expr(f"substring(text, {len(SUMMARY_HEAD) + 1})").alias("summary"))


def reset(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turns without those of ``conversations`` (conv_id)."""
    return turns.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")


def prompt_block(turns: DataFrame) -> DataFrame:
    """(conv_id, block): the turns as a summariser reads them, oldest first."""
    line = lambda x: F.concat(F.lit("["), F.upper(x["role"]), F.lit("]\n"), x["text"])
    return _ordered(turns, "role", "text").select("conv_id", F.array_join(F.transform("t", line), "\n").alias("block"))


def truncate(turns: DataFrame, budget: Budget = Budget(), summarise=None, only_over: bool = True) -> DataFrame:
    """Turns in which older ones of a conversation beyond the budget are one summary turn, placed before the newest ``keep``.

    ``summarise(column)`` turns the older turns' texts, joined by blanks, into a summary; the stand-in keeps the first fifth
    of the words.
    """
    summarise = summarise or first_fifth
    turns = with_tokens(turns)
    if only_over:
        over = totals(turns, budget).select("conv_id", "over")
    else:
        over = turns.select("conv_id").distinct().withColumn("over", F.lit(True))
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    placed = turns.join(over, "conv_id").withColumn("_n", F.row_number().over(newest))
    old = F.col("over") & (F.col("_n") > budget.keep)
    kept = placed.where(~old).select("conv_id", "turn", "role", "text", "token_count", "is_summary")
    text = summarise(F.array_join(F.transform("t", lambda x: x["text"]), " "))
    summed = _ordered(placed.where(old), "text").select("conv_id", F.get("t", F.size("t") - 1)["turn"].alias("turn"), text.alias("_s"))
    rows = summed.select("conv_id", "turn", F.lit("system").alias("role"), F.concat(F.lit(SUMMARY_HEAD), F.col("_s")).alias("text"), count_tokens(F.col("_s")).cast("long").alias("token_count"), F.lit(True).alias("is_summary"))
    return kept.unionByName(rows)


def step(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(conv_id, truncated, total_tokens, n_turns, summary): the truncation node for many conversations at once."""
    turns = with_tokens(turns)
    over = totals(turns, budget)
    cut = truncate(turns, budget)
    held = context(cut, budget.tokens).groupBy("conv_id").agg(F.sum("token_count").alias("held"), F.count("*").alias("n"))
    summary = cut.where("is_summary").select("conv_id", F.expr(f"substring(text, {len(SUMMARY_HEAD) + 1})").alias("summary"))
    size = turns.groupBy("conv_id").agg(F.count("*").alias("all"))
    joined = over.join(held, "conv_id", "left").join(summary, "conv_id", "left").join(size, "conv_id")
    return joined.select("conv_id", F.col("over").alias("truncated"), F.when(F.col("over"), F.coalesce("held", F.lit(0))).otherwise(F.col("total_tokens")).alias("total_tokens"), F.when(F.col("over"), F.coalesce("n", F.lit(0))).otherwise(F.col("all")).alias("n_turns"), "summary")
