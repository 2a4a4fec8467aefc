import pytest

from tests.oracle import agree
from weftline.llm import catalog

Q, O = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(O))
def test_query_agrees_with_sql(spark, data, name):
    agree(spark, data, Q[name], O[name])


COLUMNS = {"p1_found": ["article_id"], "p3_found": ["article_a_id", "article_b_id"], "p6_found": ["group_id", "field", "article_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "band"]}


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_query_has_rows_and_columns(spark, data, name):
    """Results themselves are tested against brute force in this folder; here only that the registered query has rows in the columns asked for."""
    df = Q[name](spark, data)
    assert df.count() > 0 and df.columns == COLUMNS.get(name, df.columns)
