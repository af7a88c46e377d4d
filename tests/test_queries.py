import parity
import pytest

from trawl import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return parity.database(SF)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, db, name):
    got, want = parity.rows_of_spark(queries.QUERIES[name](spark, SF)), parity.rows_of_sql(db, queries.ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
