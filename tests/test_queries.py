"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from pagequarry.plans import load_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_only_the_whole_workflow_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"answer_workflow"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == sorted(map(str, found.fetchall()))


def test_answers_of_the_workflow(spark, sf):
    rows = QUERIES["answer_workflow"](spark, sf).collect()
    assert len(rows) == 40 and {r.route for r in rows} <= {"fast", "slow"} and all(r.verified and r.n_found >= 1 for r in rows if r.answer)


def test_entry_and_registration_without_the_training_data_subpackage(spark):
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score", "source", "text"] and df.count() == 600
    code = "import sys; sys.modules['pagequarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(x.startswith('op') for x in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
