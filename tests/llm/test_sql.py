"""Queries of this package that SQL can express, and those over the smallest table that can't: that they run and are whole."""

import pytest
from compare import rows

from millrace.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, duck, sf_dir, name):
    assert rows(queries()[name](spark, sf_dir).toPandas()) == rows(duck.sql(oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_whole(spark, duck, sf_dir, name):
    found = queries()[name](spark, sf_dir).toPandas()
    if name.startswith("op10"):
        assert set(found["conv_id"]) == {-7} | {r[0] for r in duck.sql("SELECT DISTINCT conv_id FROM conversations").fetchall()}
    else:
        assert set(found["doc_id"]) == {r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall()}
