"""String, date, number, array and JSON functions, built in and inside the JVM; the UDF surface in Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table


@query("""
SELECT c_custkey, upper(c_name) AS up, CAST(length(c_name) AS INTEGER) AS n, substring(c_name, 3, 5) AS part, replace(c_name, 'u', '_') AS swapped,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, reverse(c_mktsegment) AS back, c_mktsegment || '-' || c_nationkey AS joined
FROM customer
""")
def fn_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper("c_name").alias("up"), F.length("c_name").alias("n"), F.substring("c_name", 3, 5).alias("part"),
        F.replace(F.col("c_name"), F.lit("u"), F.lit("_")).alias("swapped"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.reverse("c_mktsegment").alias("back"), F.concat("c_mktsegment", F.lit("-"), "c_nationkey").alias("joined"),
    )


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, split_part(url, '://', 1) AS scheme,
       regexp_replace(url, '[0-9]+', '#', 'g') AS masked, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS links
FROM pages
""")
def fn_regex_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"),
        F.regexp_replace("url", "[0-9]+", "#").alias("masked"), F.regexp_count("html", F.lit("<a ")).alias("links"),
    )


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
       CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, strftime(o_orderdate, '%d/%m/%Y') AS shown, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS days,
       CAST(last_day(o_orderdate) AS DATE) AS month_end
FROM orders
""")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.date_format(F.date_trunc("month", d), "yyyy-MM-dd").alias("month"), F.dayofweek(d).alias("dow"),
        F.date_format(d, "dd/MM/yyyy").alias("shown"), F.date_diff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.last_day(d).alias("month_end"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up, round(sqrt(l_extendedprice), 6) AS root,
       round(ln(l_extendedprice), 6) AS log, CAST(l_orderkey // 7 AS BIGINT) AS whole, CAST(l_orderkey % 7 AS BIGINT) AS rest, abs(l_discount - 0.05) < 0.02 AS near
FROM lineitem
""")
def fn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(price).cast("long").alias("down"), F.ceil(price).cast("long").alias("up"), F.round(F.sqrt(price), 6).alias("root"),
        F.round(F.ln(price), 6).alias("log"), F.expr("l_orderkey div 7").alias("whole"), (F.col("l_orderkey") % 7).alias("rest"), (F.abs(F.col("l_discount") - 0.05) < 0.02).alias("near"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size,
       coalesce(nullif(o_orderstatus, 'P'), 'open') AS status, greatest(o_custkey, 100) AS g, CAST(o_totalprice AS DECIMAL(15, 2)) AS price
FROM orders
""")
def fn_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(price > 200000, "large").when(price > 50000, "medium").otherwise("small").alias("size"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("open")).alias("status"), F.greatest("o_custkey", F.lit(100)).alias("g"), price.cast("decimal(15,2)").alias("price"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive,
       round(list_max(embedding), 6) AS largest
FROM embeddings
""")
def fn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"), F.round(F.array_max(e).cast("float"), 6).alias("largest"),
    )


@query("SELECT lower(word) AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def fn_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, CAST(levenshtein(lang, source) AS INTEGER) AS distance FROM documents")
def fn_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.levenshtein("lang", "source").alias("distance"))


@query("SELECT user_id, round(exp(sum(ln(value)) / count(value)), 4) AS mean FROM events GROUP BY user_id")
def udf_geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over partial sums in pandas: each task sends one row a user, whatever its events. Null values don't count; events without a user are a user."""
    def logs(frames):
        for f in frames:
            g = np.log(f["value"]).groupby(f["user_id"], dropna=False).agg(["sum", "count"]).reset_index()
            yield pd.DataFrame({"user_id": g["user_id"].astype("Int64"), "s": g["sum"], "n": g["count"]})

    part = table(spark, sf_dir, "events").select("user_id", "value").mapInPandas(logs, "user_id long, s double, n long")
    return part.groupBy("user_id").agg(F.round(F.exp(F.try_divide(F.sum("s"), F.sum("n"))), 4).alias("mean"))


@query("SELECT conv_id, turn, role || ': ' || CAST(length(text) AS VARCHAR) AS shown FROM conversations")
def udf_arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function in pandas, in Arrow batches. A null role or text gives null."""
    @F.pandas_udf("string")
    def shown(role: pd.Series, text: pd.Series) -> pd.Series:
        return role + ": " + text.str.len().astype("Int64").astype("string")

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", shown("role", "text").alias("shown"))


@query("SELECT conv_id, turn, md5(strip_accents(text)) AS plain FROM conversations")
def udf_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Spark has no function for: letters without their accents, by canonical decomposition."""
    @F.pandas_udf("string")
    def plain(text: pd.Series) -> pd.Series:
        strip = lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        return text.map(strip)

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(plain("text")).alias("plain"))
