"""Table functions in Python: one over each row's values, called sideways with LATERAL, and one over a table's partitions.

`analyze` fixes what is returned from the call's arguments, and what the function needs of its table: how it is dealt out and ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from millrace.registry import query
from millrace.sources.tables import table


class Shingles:
    """shingles(text, n): place and the n words from there on, one column for each. A null text has none, as has one of fewer words."""

    @staticmethod
    def analyze(text: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not n.isConstantExpression or n.value is None or n.value < 1:
            raise ValueError("n must be a constant of at least 1")
        schema = StructType().add("place", LongType())
        for k in range(n.value):
            schema = schema.add(f"word{k + 1}", StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None, n: int) -> Iterator[tuple]:
        words = [w for w in (text or "").split(" ") if w]
        for k in range(len(words) - n + 1):
            yield (k + 1, *words[k : k + n])


class Runs:
    """runs(table): for each user the runs of events of one type, in order of time: the type, its first event, and how many there are."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        missing = {"user_id", "ts", "event_id", "event_type"} - {f.name for f in rows.dataType.fields}
        if missing:
            raise ValueError(f"the table has no {', '.join(sorted(missing))}")
        schema = StructType().add("user_id", LongType()).add("event_type", StringType()).add("first_event", LongType()).add("n", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("user_id")], orderBy=[OrderingColumn("ts"), OrderingColumn("event_id")])

    def __init__(self) -> None:
        self.now: list | None = None

    def eval(self, rows) -> Iterator[tuple]:
        if self.now and self.now[1] == rows["event_type"]:
            self.now[3] += 1
            return
        if self.now:
            yield tuple(self.now)
        self.now = [rows["user_id"], rows["event_type"], rows["event_id"], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.now:
            yield tuple(self.now)


def registered(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("shingles", F.udtf(Shingles))
    spark.udtf.register("runs", F.udtf(Runs))


@query("""
WITH w AS (SELECT page_id, list_filter(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' '), lambda x: x <> '') AS words FROM pages)
SELECT page_id, CAST(i AS BIGINT) AS place, words[i] AS word1, words[i + 1] AS word2 FROM w, unnest(range(1, len(words))) AS u(i)
""")
def udtf_lateral_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of pages' titles."""
    registered(spark)
    titles = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return spark.sql("SELECT page_id, place, word1, word2 FROM {titles}, LATERAL shingles(title, 2)", titles=titles)


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS s FROM a)
SELECT user_id, event_type, list(event_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST)[1] AS first_event, count(*) AS n FROM b GROUP BY user_id, event_type, s
""")
def udtf_table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's runs of events of one type; the function itself says how its table is dealt out and ordered."""
    registered(spark)
    return spark.sql("SELECT user_id, event_type, first_event, n FROM runs(TABLE({events}))", events=table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"))
