"""Tables of a folder, and the file formats that Spark reads and writes itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share. Where the session names none, a temporary one, on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/millrace/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below scratch() that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def round_trip(df: DataFrame, form: str, **options: str) -> DataFrame:
    """df written in a format and read again with its own schema, so nothing is inferred."""
    path = scratch(df.sparkSession)
    df.write.format(form).options(**options).save(path)
    return df.sparkSession.read.format(form).options(**options).schema(df.schema).load(path)


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(_ORDERS)
def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)


@query(_ORDERS)
def source_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "orc")


@query(_ORDERS)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "csv", header="true")


@query(_ORDERS)
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "json", compression="gzip")


@query(_ORDERS)
def source_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "xml", rowTag="order", rootTag="orders")


@query("SELECT o_orderkey || ' ' || o_orderpriority AS value FROM orders WHERE o_orderkey IS NOT NULL AND o_orderpriority IS NOT NULL")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(F.concat("o_orderkey", F.lit(" "), "o_orderpriority").alias("value")).where("value is not null")
    return round_trip(lines, "text")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in folders by status; the filter reads one of them."""
    path = scratch(spark)
    orders = _orders(spark, sf_dir)
    orders.write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema(orders.schema).parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
