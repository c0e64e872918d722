"""Registered queries against DuckDB, and the entry without the corpus operators."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from fathomline.plans.queries import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    rows = frame.collect()
    assert rows
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        columns = sorted(expected.columns)
        assert sorted(frame.columns) == columns
        place = [expected.columns.index(c) for c in columns]
        assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[k]) for k in place] for r in expected.fetchall())


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.stdout.split() == [str(len(QUERIES)), "False", "False"], got.stderr
