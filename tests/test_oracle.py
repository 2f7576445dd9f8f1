"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from catalogue.spark_queries import QUERIES
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


# Too few rows there: no event of these tables falls into the choice at the smallest size.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    problem = compare(entry_points.queries()[name](spark, FOLDER), connection, entry_points.oracle_sql()[name])
    assert problem is None or (problem == "both empty" and name in MAY_BE_EMPTY), problem
