"""Registered queries over the smallest tables against their SQL."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from lattica import queries

DATA = __spark_entry__.DATA
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["v", "k", "y"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, db, name):
    got = queries.queries()[name](spark, DATA)
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("absent", ["public_tokenizers", "regex", "tiktoken", "lattica.llm", "corpus_pipeline"])
def test_entry_without_what_the_other_operators_need(tmp_path, absent):
    """What is not installed costs the queries that need it, and no others."""
    code = f"import sys; sys.modules['{absent}'] = None; import __spark_entry__ as e; assert 'gcn_layer' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    if absent not in ("tiktoken", "corpus_pipeline"):
        code += " and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.abspath(__spark_entry__.__file__))}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=tmp_path, timeout=120)
