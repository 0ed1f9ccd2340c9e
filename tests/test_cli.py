"""The command line over a stored collection: nothing is indexed or embedded again, and a chat remembers."""

import io

from pagequarry import cli, hooks
from pagequarry.operators import retrieval
from pagequarry.operators.memory import Budget
from pagequarry.sources.collections import Collections


def test_chat_commands_and_memory():
    chat = cli.Chat(Budget(tokens=12, keep=1))
    assert chat.command("history") == "nothing was said yet" and chat.command("What?") is None
    for role, text in (("user", "one two three"), ("assistant", "four five six seven"), ("user", "eight nine ten eleven twelve")):
        chat.add(role, text)
    assert chat.command("history").splitlines() == ["[USER] one two three", "[ASSISTANT] four five six seven", "[USER] eight nine ten eleven twelve"]
    assert chat.command("state") == "turns=3, kept=2, tokens=8 of 12, truncated=True, summary=one [... compressed]"
    assert chat.command("clear") == "cleared" and chat.command("state").startswith("turns=0, kept=0")


def test_a_stored_collection_is_asked_without_a_new_index(spark, tmp_path, monkeypatch, capsys):
    pages = [("a.pdf", 1, "# Revenue\nThe revenue of the year was 5 million."), ("b.pdf", 2, "# Cost\nThe cost was lower than before.")]
    spark.createDataFrame(pages, "source_doc string, page_number int, text string").write.parquet(str(tmp_path / "pages"))
    root = ["-c", "r", "--root", str(tmp_path / "c")]
    assert cli.main(["ingest", str(tmp_path / "pages"), *root]) == 0
    held = Collections(spark, str(tmp_path / "c"))
    assert held.names() == ["r"] and held.index("r").docs.count() == held.vectors("r").rows.count() == 2 and held.index("none") is None
    monkeypatch.setattr(retrieval, "build_index", None)
    asked, embed = [], hooks.embed
    monkeypatch.setattr(hooks, "embed", lambda df, load: (asked.append(df.count()), embed(df, load))[1])
    monkeypatch.setattr("sys.stdin", io.StringIO("What was the revenue?\nhistory\nstate\n\nexit\nnever\n"))
    assert cli.main(["chat", *root]) == 0
    said = capsys.readouterr().out
    assert "[Source: a.pdf, page 1]" in said and "[USER] What was the revenue?" in said and "turns=2" in said and "never" not in said
    assert set(asked) <= {0, 1}
