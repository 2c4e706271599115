"""Every registered query with SQL gives the SQL's rows; the rest run and give rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = ("e13_", "e14_", "e15_")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith(SLOW)])
def test_query(spark, con, name):
    rows, problems = compare(spark, con, FOLDER, queries()[name], oracle_sql().get(name))
    assert not problems
    assert rows > 0 or name == "v5_line_findings_text"


def test_entry(spark):
    assert entry(spark).columns[:3] == ["id", "language", "code_hash"]


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
