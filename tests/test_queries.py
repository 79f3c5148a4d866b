import pytest
from oracle import compare, connect

from millrace import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql().get(name)
    if sql:
        compare(df, connect(SF), sql)
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
