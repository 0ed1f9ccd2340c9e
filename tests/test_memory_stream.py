"""Memory that runs turn by turn: by hand, against the single step, and as a stream of turns in any order."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import memory
from pagequarry.streaming import memory as running

TURNS = "conv_id long, turn int, role string, text string"
BUDGET = memory.Budget(tokens=60, keep=2)


def talk(conv, n, seed=0, words=(1, 25)):
    rng = random.Random(conv * 1000 + seed)
    return [(conv, i, ["user", "assistant"][i % 2], " ".join(f"w{conv}t{i}n{j}" for j in range(rng.randint(*words)))) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def by_hand(turns, budget):
    """The node after each turn, in the plainest form."""
    stored, summary, cut = [], None, False
    for _, _, _, text in turns:
        stored.append(text)
        cut = sum(len(t.split()) for t in stored) >= budget.tokens
        if cut and len(stored) > budget.keep:
            old, stored = stored[: -budget.keep], stored[-budget.keep :]
            head = [] if summary is None else [memory.SUMMARY_HEAD + summary]
            words = " ".join(head + old).split()
            summary = " ".join(words[: len(words) // 5]) + " [... compressed]"
    return cut, summary, [t for t in stored]


def test_batch_equals_the_node_by_hand(spark):
    made = [t for c in range(30) for t in talk(c, 3 + c)]
    got = {r.conv_id: r for r in running.run(spark.createDataFrame(made, TURNS), BUDGET).collect()}
    assert len(got) == 30 and any(r.truncated for r in got.values()) and any(r.summary and not r.truncated for r in got.values())
    for c in range(30):
        cut, summary, stored = by_hand([t for t in made if t[0] == c], BUDGET)
        assert (got[c].truncated, got[c].summary, got[c].last_turn) == (cut, summary, 2 + c)
        if not cut:
            assert got[c].total_tokens == sum(len(t.split()) for t in stored) and got[c].n_turns == len(stored) + (summary is not None)


def test_agrees_with_the_single_step(spark):
    """Where the last turn is the one that reaches the budget, or none does."""
    made = [t for c in range(10) for t in talk(c, 4, words=(1, 10))] + [(c, 4, "user", "long " * (55 if c % 2 else 1)) for c in range(10)]
    df = spark.createDataFrame(made, TURNS)
    step = rows(memory.step(df, BUDGET).select("conv_id", "truncated", "total_tokens", "n_turns", "summary"))
    assert rows(running.run(df, BUDGET).drop("last_turn")) == step and sum(r[1] for r in step) == 5


def stream(spark, base, budget=BUDGET, **how):
    arriving = spark.readStream.schema(TURNS + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    running.memory_stream(arriving, f"{base}/out", f"{base}/mark", "at", budget, **how).awaitTermination(300)
    return rows(running.latest_memory(spark, f"{base}/out"))


def send(spark, base, turns):
    at = (F.lit("2024-01-01 00:00:00").cast("timestamp").cast("long") + F.col("turn") * 60).cast("timestamp")
    spark.createDataFrame(turns, TURNS).withColumn("at", at).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_turns_in_any_order_and_again_end_like_the_batch(spark, tmp_path):
    made = [t for c in range(12) for t in talk(c, 2 + 2 * c)] + [(50, 0, "user", None)]
    mixed = made + random.Random(1).sample(made, 40)
    random.Random(2).shuffle(mixed)
    whole = rows(running.run(spark.createDataFrame(made, TURNS), BUDGET))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for part in (mixed[:60], mixed[60:120], mixed[120:]):
        send(spark, tmp_path, part)
    first = stream(spark, tmp_path)
    assert first == whole and stream(spark, tmp_path) == whole  # a second run finds nothing
    more = talk(3, 20)[8:]
    send(spark, tmp_path, more + made[:5])
    assert stream(spark, tmp_path) == rows(running.run(spark.createDataFrame(made + more, TURNS), BUDGET))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_a_gap_is_given_up_when_the_watermark_has_passed(spark, tmp_path):
    made = talk(1, 6)
    send(spark, tmp_path, made[:2] + made[3:])
    assert [r[:2] for r in stream(spark, tmp_path, late="1 hour")] == [(1, 1)]
    send(spark, tmp_path, [(2, 600, "user", "much later")])
    send(spark, tmp_path, [(2, 601, "user", "later still")])
    got = {r[0]: r for r in stream(spark, tmp_path, late="1 hour")}
    assert got[1] == rows(running.run(spark.createDataFrame(made[:2] + made[3:], TURNS), BUDGET))[0]


def test_empty_and_odd_turns(spark, tmp_path):
    assert running.run(spark.createDataFrame([], TURNS), BUDGET).collect() == []
    odd = [(None, 0, "user", "a"), (1, None, "user", "a"), (1, 0, "user", "b b"), (1, 0, "user", "a"), (1, 1, None, None)]
    assert rows(running.run(spark.createDataFrame(odd, TURNS), BUDGET)) == [(1, 1, False, 1, 2, None)]


@pytest.mark.parametrize("budget", [memory.Budget(tokens=1, keep=1), memory.Budget(tokens=0, keep=3)])
def test_state_is_bounded_by_the_budget(budget):
    session = running.Session()
    for i in range(500):
        session.add(i, "some words of this turn", 5, budget)
        assert len(session.kept) <= budget.keep and (session.summary is None or len(session.summary.split()) < 30)
