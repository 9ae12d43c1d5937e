"""Every registered query with SQL gives the same rows as DuckDB."""

import ast
from pathlib import Path

import pytest

from checks.compare import compare, duckdb_connection
from checks.oracles import ORACLES
from checks.queries import REGISTERED
from tests.conftest import DATA


@pytest.fixture(scope="module")
def connection():
    return duckdb_connection(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, connection, name):
    assert compare(spark, connection, DATA, name) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(REGISTERED)


def test_foreign_keys_hold(connection):
    """The views leave out joins that only foreign keys make needless."""
    missing = connection.execute(
        """SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
        (SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)),
        (SELECT count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)),
        (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))"""
    ).fetchall()
    assert missing == [(0, 0, 0, 0)]


def test_no_module_defines_a_name_twice():
    root = Path(__file__).resolve().parent.parent
    for path in [*root.glob("*.py"), *root.glob("basketwise/**/*.py"), *root.glob("checks/*.py"), *root.glob("tests/**/*.py")]:
        tree = ast.parse(path.read_text())
        names = [node.name for node in tree.body if isinstance(node, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path
