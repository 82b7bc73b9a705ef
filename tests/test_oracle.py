"""Every registered query against its SQL on the smallest tables.

Most of a small query's time is planning on one thread, so several run at once in the shared session; a test waits for its own.
"""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, open_tables

SF = "/root/testdata/sf0.001"
AT_ONCE = 6
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def outcome(request, spark):
    """name -> the outcome of its query, started for all selected tests at once."""
    con = open_tables(SF)
    chosen = [i.callspec.params["name"] for i in request.session.items if i.path == request.path and hasattr(i, "callspec")]

    def run(name):
        if name in SQL:
            return compare(spark, con.cursor(), SF, QUERIES[name], SQL[name])
        return None if QUERIES[name](spark, SF).count() > 0 else "no rows"

    with ThreadPoolExecutor(AT_ONCE) as pool:
        started = {name: pool.submit(run, name) for name in chosen}
        yield lambda name: started[name].result()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(outcome, name):
    assert outcome(name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(outcome, name):
    assert outcome(name) is None


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["label", "anchors", "mean_abs_acceleration"]
    assert out.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
