import pytest

from tests.oracle import agree
from weftline.plans import catalog

Q, O = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_query_agrees_with_sql(spark, data, name):
    agree(spark, data, Q[name], O[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_query_runs(spark, data, name):
    df = Q[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
