"""The jobs: growing input, reruns, runs that fail half-way, odd rows, the command line, and their queries against SQL."""

import json
import logging
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import chunk_documents as cd
from jobs import queries
from jobs import ratio_report as rr
from jobs.common import make_config

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, source string"


def settings(base, **more):
    return cd.Settings(documents=f"{base}/in", output=f"{base}/out", checkpoint=f"{base}/mark", **more)


def add(spark, base, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")


def held(spark, base):
    return sorted(cd.current_chunks(spark, f"{base}/out").select("doc_id", "chunk_index", "text", "source", "source_doc").collect(), key=str)


def copies_of_documents(spark, sf, base):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("doc_id < 120").repartition(2).write.mode("append").parquet(f"{base}/in")
    return docs


# --- chunks of documents ---------------------------------------------------------------------------------------------


def test_two_runs_over_growing_input_equal_one_over_all(spark, sf, tmp_path):
    docs = copies_of_documents(spark, sf, tmp_path)
    first = cd.run(spark, settings(tmp_path))
    assert first.rows_read == first.documents_new == docs.where("doc_id < 120").count() and first.chunks_written > 0
    assert cd.run(spark, settings(tmp_path)) == cd.Report(0, 0, 0, 0)  # nothing new, nothing written
    docs.where("doc_id >= 100").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")  # twenty of these are known
    second = cd.run(spark, settings(tmp_path, files_per_batch=1))
    assert second.batches == 2 and second.rows_read == docs.where("doc_id >= 100").count() and second.documents_new == docs.where("doc_id >= 120").count()
    docs.write.parquet(f"{tmp_path}/whole/in")
    cd.run(spark, settings(tmp_path / "whole"))
    assert held(spark, tmp_path) == held(spark, tmp_path / "whole") and len(held(spark, tmp_path)) >= docs.where("text <> ''").count()
    assert cd.ledger(spark, f"{tmp_path}/out").count() == docs.count()


def test_a_changed_text_is_a_new_version_and_may_change_back(spark, tmp_path):
    for text in ("the first text of it", "another text of it", "another text of it", "the first text of it"):
        add(spark, tmp_path, [(1, text, "a"), (2, "what never changes", "a")])
        cd.run(spark, settings(tmp_path))
    assert [(r.doc_id, r.text) for r in held(spark, tmp_path)] == [(1, "the first text of it"), (2, "what never changes")]
    versions = cd.ledger(spark, f"{tmp_path}/out").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in versions} == {1: 3, 2: 1}


def test_a_batch_that_fails_half_way_runs_again_with_the_same_rows(spark, tmp_path, monkeypatch):
    add(spark, tmp_path, [(i, f"text number {i} of this batch", "a") for i in range(20)])
    cd.run(spark, settings(tmp_path))
    add(spark, tmp_path, [(i, f"text number {i} of the next batch", "b") for i in range(10, 30)])
    whole, calls = cd._replace, []

    def failing(rows, path, *keys):
        calls.append(path)
        if path.endswith("chunks"):
            raise RuntimeError("lost")
        whole(rows, path, *keys)

    monkeypatch.setattr(cd, "_replace", failing)
    with pytest.raises(Exception, match="lost"):
        cd.run(spark, settings(tmp_path))
    monkeypatch.setattr(cd, "_replace", whole)
    assert len(calls) == 2  # the ledger had been written
    again = cd.run(spark, settings(tmp_path))
    assert (again.batches, again.documents_new, again.chunks_written) == (1, 20, 20)
    got = held(spark, tmp_path)
    assert len(got) == 30 and {r.source for r in got if r.doc_id >= 10} == {"b"} and cd.ledger(spark, f"{tmp_path}/out").count() == 40


def test_odd_rows_have_the_results_of_the_docstring(spark, tmp_path, caplog):
    long = "a long sentence of many words.\n\n" * 3000
    add(spark, tmp_path, [
        (1, None, "a"), (2, "", "a"), (3, "text without source", None), (4, "text of an empty source", ""), (None, "text without id", "a"), (5, "b text", "s/t=1"), (5, "a text", "s/t=1"),
        (5, "a text", "s/t=1"), (5, None, "s/t=1"), (6, long, "007"), (7, "tab\tand line\nfeed", "7"), (8, " private  characters", "7"),
    ])
    with caplog.at_level(logging.INFO, "jobs.chunk_documents"):
        report = cd.run(spark, settings(tmp_path))
    assert report.rows_read == 12 and report.documents_new == 8 and "read 12 rows" in caplog.text and "wrote 8 documents' entries" in caplog.text
    got = held(spark, tmp_path)
    assert {(r.doc_id, r.source, r.source_doc) for r in got} >= {(3, "unknown", None), (4, "unknown", ""), (5, "s/t=1", "s/t=1"), (6, "007", "007"), (7, "7", "7")}
    assert [r.text for r in got if r.doc_id == 5] == ["a text"] and {1, 2} & {r.doc_id for r in got} == set()
    assert sum(r.text.count("a long sentence of many words.") for r in got if r.doc_id == 6) >= 3000
    assert {p.name for p in (tmp_path / "out/chunks/batch=0").iterdir() if p.is_dir()} >= {"source=unknown", "source=007", "source=7"}


def test_empty_input_single_file_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/in")
    assert cd.run(spark, settings(tmp_path / "none")).chunks_written == 0 and held(spark, tmp_path / "none") == []
    names = ("batch", "chunk_id", "text_sha256", "last", "doc", "token_count")
    spark.createDataFrame([(1, "some text here", "a")], DOCS).withColumns({n: F.lit("own") for n in names}).coalesce(1).write.parquet(f"{tmp_path}/one/files")
    file = next((tmp_path / "one/files").glob("part-*.parquet"))
    one = cd.Settings(str(file), f"{tmp_path}/one/out", f"{tmp_path}/one/mark")
    assert cd.run(spark, one).chunks_written == 1 and cd.run(spark, one).rows_read == 0
    assert [r.text for r in held(spark, tmp_path / "one")] == ["some text here"]


# --- ratio report ----------------------------------------------------------------------------------------------------


def test_years_replace_their_own_partitions(spark, sf, tmp_path):
    whole = rr.run(spark, rr.Settings(sf, f"{tmp_path}/all"))
    years = sorted(whole.rows_written)
    assert whole.rows_read == {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in rr.TABLES} and min(whole.rows_written.values()) > 0
    for first, last in ((years[0], years[2]), (years[2], years[4]), (years[3], years[-1])):
        part = rr.run(spark, rr.Settings(sf, f"{tmp_path}/parts", first, last))
        assert sorted(part.rows_written) == [y for y in years if first <= y <= last]
    rows = lambda name: sorted(map(str, rr.written(spark, f"{tmp_path}/{name}").collect()))
    assert rows("parts") == rows("all") and rr.run(spark, rr.Settings(sf, f"{tmp_path}/all")) == whole and rows("parts") == rows("all")
    assert {p.name for p in (tmp_path / "all").iterdir() if p.is_dir()} == {f"fy={y}" for y in years}


def test_only_the_wanted_years_are_scanned(spark, sf, capsys):
    from pagequarry.plans.catalog import statements

    statements(spark, sf, 1995, 1996).explain("formatted")
    pushed = [x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x and "o_orderdate" in x]
    assert pushed and "GreaterThanOrEqual(o_orderdate,1995-01-01" in pushed[0] and "LessThan(o_orderdate,1997-01-01" in pushed[0]


def test_growth_rank_and_errors_by_hand(spark):
    rows = spark.createDataFrame([("a", 2000, 10.0, 100.0), ("a", 2001, 30.0, 100.0), ("a", 2003, 30.0, 100.0), ("b", 2001, 30.0, 100.0), ("c", 2001, 5.0, 0.0), ("d", 2001, 6.0, 60.0)], "company string, fy int, net_income double, total_assets double")
    made = {(r.company, r.fy): r for r in rr.with_rank(rr.with_growth(rr.metric_rows(rows, ["roa"]))).collect()}
    assert made["a", 2001].growth_percent == 200.0 and made["a", 2000].growth_percent is None and made["a", 2003].growth_percent is None
    assert [made[c, 2001].rank for c in "abcd"] == [1, 1, None, 3] and made["a", 2001].n_companies == 3
    assert made["c", 2001].error == "not computable" and made["c", 2001].value is None and made["c", 2001].unit is None
    with pytest.raises(ValueError, match="unknown metrics: nothing"):
        rr.metric_rows(rows, ["nothing"])


def test_a_table_without_orders_gives_no_rows(spark, sf, tmp_path):
    for name in ("lineitem", "orders", "customer", "nation"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert rr.run(spark, rr.Settings(str(tmp_path), f"{tmp_path}/out")) == rr.Report(dict.fromkeys(rr.TABLES, 0), {})


# --- command line, configs, queries ----------------------------------------------------------------------------------


def test_configs_are_checked():
    assert make_config(cd.Settings, {"documents": "a", "output": "b", "checkpoint": "c", "overlap": 0}).overlap == 0
    for given, said in (({"documents": "a"}, "missing settings: checkpoint, output"), ({"documents": "a", "output": "b", "checkpoint": "c", "limit": 3}, "unknown settings: limit")):
        with pytest.raises(ValueError, match=said):
            make_config(cd.Settings, given)
    for name, value in (("most_tokens", "many"), ("overlap", True), ("files_per_batch", 1.5)):
        with pytest.raises(ValueError, match=f"{name} can't be"):
            make_config(cd.Settings, {"documents": "a", "output": "b", "checkpoint": "c", name: value})
    with pytest.raises(ValueError, match="metrics can't be"):
        make_config(rr.Settings, {"tables": "a", "output": "b", "metrics": "roe"})
    for kind, file in ((cd.Settings, "chunk_documents"), (rr.Settings, "ratio_report")):
        make_config(kind, json.loads((ROOT / f"jobs/{file}.json").read_text()))


def test_command_line(spark, sf, tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"tables": sf, "output": f"{tmp_path}/out", "metrics": ["roe"]}))
    call = [sys.executable, "-m", "jobs.ratio_report", "--config", str(config), "--set", "first_year=1995", "last_year=1995"]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "wrote 1995: 25 rows" in done.stderr
    assert {r.metric for r in rr.written(spark, f"{tmp_path}/out").collect()} == {"roe"}


def test_jobs_import_nothing_of_the_training_data_operators():
    code = "import sys; import jobs.queries; assert not any(m.startswith('pagequarry.llm') or m == 'corpus_pipeline' for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "customer", "nation"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == sorted(map(str, found.fetchall()))
    assert before == {k: spark.conf.get(k) for k in before}
