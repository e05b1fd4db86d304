"""Semi-structured values: JSON text as VARIANT, read by typed paths.

A text that isn't JSON is null, as is a path that isn't there or whose value doesn't fit the type asked for. JSON's own null is a
value of the type `void`, told apart from a missing one by `is_variant_null`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table


def parsed(rows: DataFrame, text: str, name: str = "v") -> DataFrame:
    """rows with `name`, the JSON text as a VARIANT."""
    return rows.withColumn(name, F.try_parse_json(F.col(text)))


def read(value: str, paths: dict[str, tuple[str, str]]) -> list[F.Column]:
    """A column for each name: a path and the type that its value is read as."""
    return [F.try_variant_get(F.col(value), path, kind).alias(name) for name, (path, kind) in paths.items()]


_JSON = "'{\"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || ', \"tags\": [\"' || event_type || '\", null, ' || CAST(event_id AS VARCHAR) || '], \"at\": {\"day\": \"' || strftime(ts, '%Y-%m-%d') || '\"}}'"


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k_text, json_extract_string(props, '$.nope') AS nope FROM events")
def fn_variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of each event's properties as a number and as a text, and one that isn't there."""
    rows = parsed(table(spark, sf_dir, "events"), "props")
    return rows.select("event_id", *read("v", {"k": ("$.k", "int"), "k_text": ("$.k", "string"), "nope": ("$.nope", "string")}))


@query(f"""
WITH e AS (SELECT event_id, event_type, {_JSON} AS j FROM events)
SELECT event_id, json_extract_string(j, '$.tags[0]') AS first_tag, CAST(json_extract_string(j, '$.tags[2]') AS BIGINT) AS third_tag, CAST(json_extract_string(j, '$.at.day') AS DATE) AS day,
       json_type(json_extract(j, '$.tags[1]')) = 'NULL' AS second_is_null, CAST(NULL AS INTEGER) AS no_number
FROM e
""")
def fn_variant_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values inside arrays and objects; a text that is no number is null where a number is asked for."""
    made = F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "tags": ["'), F.col("event_type"), F.lit('", null, '), F.col("event_id").cast("string"),
        F.lit('], "at": {"day": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}}'),
    )
    rows = parsed(table(spark, sf_dir, "events").withColumn("j", made), "j")
    paths = {"first_tag": ("$.tags[0]", "string"), "third_tag": ("$.tags[2]", "long"), "day": ("$.at.day", "date"), "no_number": ("$.tags[0]", "int")}
    second = F.when(F.col("v").isNotNull(), F.is_variant_null(F.try_variant_get("v", "$.tags[1]", "variant"))).alias("second_is_null")
    return rows.select("event_id", *read("v", paths), second)


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1 HAVING count(*) > 1")
def fn_variant_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a typed path: a VARIANT itself can't be grouped."""
    rows = parsed(table(spark, sf_dir, "events"), "props").select(*read("v", {"k": ("$.k", "string")}), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).where("n > 1")
