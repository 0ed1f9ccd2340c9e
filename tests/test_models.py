"""Chats whose replies are remembered, and the workflow that asks them."""

import json
import sys
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagequarry.operators import retrieval
from pagequarry.plans import workflow as w
from pagequarry.plans.models import Remembered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't have this folder

def chat(log, reply, fails=()):
    """A model that notes what it is asked in a file; it raises for prompts with one of the words in ``fails``."""

    def load():
        def run(prompts):
            with open(log, "a") as file:
                file.writelines(json.dumps(p) + "\n" for p in prompts)
            if any(word in p for p in prompts for word in fails):
                raise RuntimeError("overloaded")
            return [reply(p) for p in prompts]

        return run

    return load


def calls(log):
    return [json.loads(x) for x in Path(log).read_text().splitlines()] if Path(log).exists() else []


def remembered(tmp_path, name, reply, fails=(), **how):
    return Remembered(chat(str(tmp_path / f"{name}.log"), reply, fails), str(tmp_path / "replies"), name, wait_seconds=0.01, **how)


def test_each_prompt_is_asked_once_and_never_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"prompt {i % 5}" if i % 6 else None) for i in range(30)], "id int, p string").repartition(4).withColumns({"reply": F.lit("old"), "error": F.lit("old")})
    model = remembered(tmp_path, "upper", str.upper)
    for _ in range(2):
        got = {r.id: (r.reply, r.error) for r in model.ask(rows, F.col("p")).collect()}
        assert got == {i: (f"PROMPT {i % 5}" if i % 6 else None, None) for i in range(30)}
        assert sorted(calls(tmp_path / "upper.log")) == [f"prompt {i}" for i in range(5)]
    more = rows.union(rows.limit(1).withColumn("p", F.lit("another")))
    model.ask(more, F.col("p")).collect()
    assert calls(tmp_path / "upper.log")[5:] == ["another"]
    other = remembered(tmp_path, "lower", str.lower)
    assert {r.reply for r in other.ask(rows, F.col("p")).collect()} == {None, *(f"prompt {i}" for i in range(5))} and len(calls(tmp_path / "lower.log")) == 5
    assert model.ask(rows.limit(0), F.col("p")).collect() == []


def test_a_failing_prompt_has_its_error_and_is_asked_again_later(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{'bad' if i == 3 else 'good'} {i}") for i in range(8)], "id int, p string").coalesce(1)
    got = {r.id: (r.reply, r.error) for r in remembered(tmp_path, "m", str.upper, fails=["bad"], tries=2).ask(rows, F.col("p")).collect()}
    assert got == {i: (f"GOOD {i}", None) if i != 3 else (None, "RuntimeError: overloaded") for i in range(8)}
    before = len(calls(tmp_path / "m.log"))
    got = {r.id: (r.reply, r.error) for r in remembered(tmp_path, "m", str.upper).ask(rows, F.col("p")).collect()}
    assert got[3] == ("BAD 3", None) and calls(tmp_path / "m.log")[before:] == ["bad 3"]


def test_replies_that_are_too_few_are_an_error(spark, tmp_path):
    model = Remembered(lambda: lambda prompts: [], str(tmp_path), "silent", tries=1)
    row = model.ask(spark.createDataFrame([("a",)], "p string"), F.col("p")).first()
    assert row.reply is None and row.error == "ValueError: 0 replies to 1 prompts"


CHUNKS = [(1, "Revenue of Orchard was 5 million in 2023.", "a.pdf", 3), (2, "Orchard pays no dividend.", "a.pdf", 4), (3, "Risks of Harbour are storms.", "b.pdf", 1)]
QUESTIONS = [(10, "What was the revenue of Orchard?"), (11, "Compare the risks of Harbour with the revenue of Orchard"), (12, "Zebra quagga?")]


def flow(spark, **hooks):
    chunks = spark.createDataFrame(CHUNKS, "doc_id int, text string, source_doc string, page_number int")
    return w.Workflow(chunks, retrieval.build_index(chunks), w.Hooks(**hooks))


def ask(spark, **hooks):
    return {r.query_id: r for r in flow(spark, **hooks).answer(spark.createDataFrame(QUESTIONS, "query_id int, text string")).collect()}


def plan(prompt):
    return '[{"task_id": "t1", "description": "risks of Harbour", "strategy": "table", "key_terms": ["storms"]}, {"task_id": "t2", "description": "revenue of Orchard", "strategy": "odd"}]' if "Compare" in prompt else "I can't"


def write(prompt):
    assert "[Source: " in prompt
    return f"{prompt.count('[Source: ') - 1} chunks for {prompt.rsplit('Question: ', 1)[1]} [Source: a.pdf, page 3] [Source: ghost, page 9]"


def test_chats_take_their_places_and_are_not_asked_twice(spark, tmp_path):
    hooks = {
        "router": remembered(tmp_path, "router", lambda p: '{"route": "slow", "confidence": 0.9}' if "Compare" in p or "Zebra" in p else '{"route": "fast"}'),
        "typer": remembered(tmp_path, "typer", lambda p: " Comparative " if "Compare" in p else "nonsense"),
        "planner": remembered(tmp_path, "planner", plan), "writer": remembered(tmp_path, "writer", write),
    }
    got = ask(spark, **hooks)
    assert {q: r.route for q, r in got.items()} == {10: "fast", 11: "slow", 12: "slow"} and {q: r.task_type for q, r in got.items()} == {10: "unknown", 11: "comparative", 12: "unknown"}
    assert got[11].strategy == "table" and got[10].strategy == got[12].strategy == "all"
    assert got[10].answer.startswith("3 chunks for What was the revenue of Orchard? [Source: a.pdf") and (got[10].n_found, got[10].n_valid, got[10].verified) == (2, 1, False)
    assert all(r.errors == {} for r in got.values())
    asked = {n: len(calls(tmp_path / f"{n}.log")) for n in hooks}
    assert asked == {"router": 3, "typer": 3, "planner": 2, "writer": 3} and ask(spark, **hooks) == got
    assert {n: len(calls(tmp_path / f"{n}.log")) for n in hooks} == asked
    assert any("Revenue of Orchard was 5 million" in p for p in calls(tmp_path / "writer.log"))


def test_chats_that_fail_leave_their_errors(spark, tmp_path):
    bad = {n: remembered(tmp_path, f"bad-{n}", str, fails=["Orchard"], tries=1) for n in ("router", "typer", "planner", "writer")}
    got = ask(spark, **bad)
    assert got[10].route == "slow" and got[10].task_type == "unknown" and got[10].answer == "" and got[10].verified
    assert set(got[10].errors) == {"router", "task_type", "task_decomposition", "generation"} and set(got[12].errors) == {"generation"}


def test_the_generator_sees_the_question_and_all_evidence(spark):
    said = lambda question, evidence: F.concat(question, F.lit(" | "), F.array_join(F.transform(evidence, lambda e: e["text"]), " / "))
    got = ask(spark, generate=said)
    assert got[10].answer.startswith("What was the revenue of Orchard? | Revenue of Orchard was 5 million in 2023. / ")
