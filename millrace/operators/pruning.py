"""Joins whose plan depends on what is stored beside the rows: folders by a column that a join's other side prunes as it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import scratch, table


def by_folder(rows: DataFrame, column: str) -> DataFrame:
    """rows as a table with a folder for each value of a column, each folder in as many files as tasks have rows of it."""
    path = scratch(rows.sparkSession)
    rows.write.partitionBy(column).parquet(path)
    schema = rows.select(*(c for c in rows.columns if c != column), column).schema
    return rows.sparkSession.read.schema(schema).parquet(path)


def folders_needed(facts: DataFrame, needed: DataFrame, column: str) -> DataFrame:
    """facts whose folder is among the values of `needed`, one for each folder: the scan reads no others."""
    return facts.join(F.broadcast(needed.select(column).distinct()), column)  # a row for each folder at most


@query("""
WITH y AS (SELECT year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN y ON year(l_shipdate) = y.year GROUP BY ALL
""")
def join_pruned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of the years in which the number of pending orders was even. Which years these are is known only as the query runs."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.year("l_shipdate").alias("ship_year"))
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.year("o_orderdate").alias("ship_year")).count().where("count % 2 = 0")
    found = folders_needed(by_folder(lines, "ship_year"), pending, "ship_year")
    return found.groupBy("ship_year", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
