"""Problem queries on empty tables, on nulls with clashing columns, and against their SQL."""

import os

import pytest

from quarry.llm import queries as q
from tests.test_catalog import DATA, compare

NAMES = sorted(q.queries())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    assert q.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_nulls(spark, null_dir, name):
    q.queries()[name](spark, null_dir).collect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    compare(q.queries()[name], q.oracle_sql()[name], spark, DATA)
