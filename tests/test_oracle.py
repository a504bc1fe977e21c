"""Every registered query against its SQL in DuckDB, by value."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, folder, con):
    assert difference(QUERIES[name](spark, folder), con, SQL[name]) is None


def test_few_queries_have_no_sql():
    # The document operators have tests of their own.
    without = {n for n in set(QUERIES) - set(SQL) if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert without == {"cost_predictions", "feature_importance", "table_preview"}
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and df.columns[0] == "carrier"


def test_frame_messages_are_of_the_frame_and_of_its_size(spark, folder, con):
    # The names and the size of an upload are both checked, by the query and by its SQL.
    rules = ["extra_columns", "missing_columns", "small_file"]
    assert sorted(r.rule for r in QUERIES["upload_frame_messages"](spark, folder).collect()) == rules
    assert sorted(r[1] for r in con.execute(SQL["upload_frame_messages"]).fetchall()) == rules
