import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Hand-made documents: nulls, blanks, ties, repeated rows, a long text, clashing extra columns."""
    from hard_rows import ROWS, SCHEMA

    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
