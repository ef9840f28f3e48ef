import pytest

from grove.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(same_rows, name):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(ORACLE_SQL) == {"sampled_join_rows"}


def test_sampled_rows_are_join_rows(spark):
    join = {tuple(r) for r in QUERIES["tree_star_m2m"](spark, SF).collect()}
    got = QUERIES["sampled_join_rows"](spark, SF)
    rows = got.select("r0__n_nationkey", "r1__s_suppkey", "r1__s_nationkey", "r2__c_custkey", "r2__c_nationkey").collect()
    assert len(rows) == 200 and {tuple(r) for r in rows} <= join


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
