import os

import pytest

import __spark_entry__ as entry
import check_queries as check

FOLDER = "/root/testdata/sf0.001"
# The rest of the summaries share the plan of these; check_queries.py runs them all.
SUMMARIES = {"average_results", "wide_results", "final_table", "paired_p"}
SLOW = {n for n in entry.queries() if entry.queries()[n].__module__.endswith("analysis")} - SUMMARIES
NAMES = sorted(n for n in entry.oracle_sql() if os.environ.get("ALL_QUERIES") or n not in SLOW)


@pytest.fixture(scope="module")
def database():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, database, name):
    assert check.check(spark, database, FOLDER, name)[0] == "ok"


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
