"""Every query of the library over tables with nulls in every column, against DuckDB."""

import os

import duckdb
import pytest
from compare import rows

import __spark_entry__  # noqa: F401  registers the queries
from millrace.registry import QUERIES, SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


@pytest.fixture(scope="module")
def holes(sf_dir, tmp_path_factory):
    """The tables with about one value in twenty gone, in every column of every row alike."""
    top = tmp_path_factory.mktemp("holes")
    con = duckdb.connect()
    for name in TABLES:
        source = f"{sf_dir}/{name}.parquet"
        columns = [c for (c, *_) in con.sql(f"DESCRIBE SELECT * FROM '{source}'").fetchall()]
        some = ", ".join(f"CASE WHEN hash(r * {len(columns)} + {k}) % 20 > 0 THEN {c} END AS {c}" for k, c in enumerate(columns))
        con.sql(f"COPY (SELECT {some} FROM (SELECT row_number() OVER () AS r, * FROM '{source}')) TO '{top}/{name}.parquet' (FORMAT parquet)")
    return str(top)


@pytest.fixture(scope="module")
def holed(holes):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(holes):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{holes}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls(spark, holes, holed, name):
    found = QUERIES[name](spark, holes).toPandas()
    if name in SQL:
        assert rows(found) == rows(holed.sql(SQL[name]).df())
