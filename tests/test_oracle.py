"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import SMOKE_DIR, entry
from check_queries import compare, oracle
from offerloom.queries import all_queries, all_sql

LARGER = SMOKE_DIR.replace("0.001", "0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    return oracle(SMOKE_DIR)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, duck, name):
    problem, rows = compare(spark, duck, SMOKE_DIR, name, all_queries()[name], all_sql().get(name))
    if problem == "no rows":  # too few rows to begin with
        problem, rows = compare(spark, oracle(LARGER), LARGER, name, all_queries()[name], all_sql().get(name))
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
