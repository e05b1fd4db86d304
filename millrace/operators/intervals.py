"""Range joins that give their pairs: points in intervals, and intervals that overlap, without a nested loop.

The axis is dealt into bins of one width. A point is in one bin, an interval in each bin that it touches, and a pair is made in one bin only:
the point's, or the one in which the later of two intervals starts. So the join is an equality of bins with a filter, which Spark hashes or sorts.

The width is about the mean length of the intervals, so an interval is in about two bins; intervals over LONG bins are joined
by their own, wider bins. A full bin is a grid of cells: its points are dealt into rows and its intervals into columns, a point goes to
each cell of its row and an interval to each of its column. A bin has CELLS cells at most, so what is shuffled is at most about
2 * sqrt(CELLS) times the tables, though pairs may grow with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import round_trip, table

#: Bins that an interval touches at most before it is joined by wider ones.
LONG = 16

#: Rows of one side that a cell of a bin holds, about, as long as CELLS are enough for that.
PART = 4096

#: Cells of a bin, at most.
CELLS = 64


def _bin(value: Column, width: Column) -> Column:
    return F.floor(value / width).cast("long")


def _finite(*columns: str) -> Column:
    fit = F.lit(True)
    for c in columns:
        fit = fit & (F.abs(F.col(c)) < F.lit(float("inf")))
    return fit


def _levels(intervals: DataFrame) -> DataFrame:
    """intervals (start, end) with the `width` of their bins: a power of LONG times the mean length, so that an interval touches LONG + 1 of them at most."""
    length = F.col("end") - F.col("start")
    unit = F.lit(intervals.agg(F.avg(length)).first()[0] or 1.0)
    times = F.greatest(F.lit(0.0), F.ceil(F.log(F.greatest(length / unit, F.lit(1.0))) / F.log(F.lit(float(LONG)))) - 1)
    return intervals.withColumn("width", unit * F.pow(F.lit(float(LONG)), times))


def join_points(points: DataFrame, intervals: DataFrame, part: int = PART) -> DataFrame:
    """Columns of both where start <= at <= end. points: at (double) and others; intervals: start, end (double) and others.

    Nulls, numbers that aren't finite, and intervals that end before they start have no pairs. The sides share no names, and none is bin, width, row, rows, column or columns.
    """
    intervals = _levels(intervals.where(_finite("start", "end") & (F.col("start") <= F.col("end"))))
    widths = [r[0] for r in intervals.select("width").distinct().collect()]  # lengths differ by powers of LONG: 256 at most, a few in fact
    if not widths:
        widths = [1.0]
    placed = points.where(_finite("at")).withColumn("width", F.explode(F.array(*map(F.lit, widths)))).withColumn("bin", _bin(F.col("at"), F.col("width")))
    touched = intervals.withColumn("bin", F.explode(F.sequence(_bin(F.col("start"), F.col("width")), _bin(F.col("end"), F.col("width")))))
    full = _full(placed, touched, part)
    split = _dealt(placed.join(full, ["width", "bin"], "left"), points.columns, "row", "column")
    held = _dealt(touched.join(full, ["width", "bin"], "left"), intervals.columns, "column", "row")
    return split.join(held, ["width", "bin", "row", "column"]).where("at >= start and at <= end").drop("width", "bin", "row", "column")


def _full(placed: DataFrame, touched: DataFrame, part: int) -> DataFrame:
    """Bins of more than `part` rows of a side, a list that is short beside the tables: into how many rows points are dealt (`rows`), and into how many columns intervals (`columns`)."""
    counts = lambda rows, name: rows.groupBy("width", "bin").agg(F.count("*").alias(name))
    both = counts(placed, "p").join(counts(touched, "i"), ["width", "bin"]).where((F.col("p") > part) | (F.col("i") > part))
    wanted = both.withColumn("a", F.ceil(F.col("p") / part)).withColumn("d", F.ceil(F.col("i") / part))
    # where that is more than CELLS, the grid that copies least: about as many copies of points as of intervals
    fewer = F.least("a", F.greatest(F.lit(1), F.least(F.lit(CELLS), F.round(F.sqrt(CELLS * F.col("p") / F.col("i"))).cast("long"))))
    rows = F.when(F.col("a") * F.col("d") <= CELLS, F.col("a")).otherwise(fewer)
    grid = wanted.withColumn("rows", rows.cast("long")).withColumn("columns", F.least("d", F.floor(CELLS / F.col("rows"))).cast("long"))
    return F.broadcast(grid.select("width", "bin", "rows", "columns"))


def _dealt(rows: DataFrame, columns: list[str], own: str, other: str) -> DataFrame:
    """rows with a drawn number `own` and, once for each, all numbers `other`."""
    draw = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in columns), F.monotonically_increasing_id()), F.coalesce(f"{own}s", F.lit(1)))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}s", F.lit(1)) - 1))
    return rows.withColumn(own, draw.cast("long")).withColumn(other, each).drop("rows", "columns")


def join_overlaps(left: DataFrame, right: DataFrame, part: int = PART) -> DataFrame:
    """Columns of both where the intervals share a point; each has start and end (double) and others, left's as they are, right's ends as other_start and other_end.

    Two intervals overlap if one holds the other's start. Pairs are found as points in intervals, once from each side: starts of the
    right in the left, and starts of the left in the right behind which the right's start doesn't lie.
    """
    left = left.where(_finite("start", "end") & (F.col("start") <= F.col("end")))
    right = right.where(_finite("start", "end") & (F.col("start") <= F.col("end"))).withColumnsRenamed({"start": "other_start", "end": "other_end"})
    first = join_points(right.withColumn("at", F.col("other_start")), left, part).drop("at")
    back = join_points(left.withColumn("at", F.col("start")).withColumnsRenamed({"start": "_start", "end": "_end"}), right.withColumnsRenamed({"other_start": "start", "other_end": "end"}), part)
    back = back.where("start < _start").drop("at").withColumnsRenamed({"start": "other_start", "end": "other_end"}).withColumnsRenamed({"_start": "start", "_end": "end"})
    return first.unionByName(back)


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 50")
def join_range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts whose price lies within 50 above their balance."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("at"))
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("start"), (F.col("s_acctbal") + 50).alias("end"))
    return join_points(parts, bands).select("s_suppkey", "p_partkey")


_SPANS = """
WITH o AS (SELECT o_custkey AS c, epoch(min(o_orderdate)) AS s, epoch(max(o_orderdate)) AS e, count(*) AS n FROM orders GROUP BY o_custkey),
l AS (SELECT l_suppkey AS k, epoch(min(l_shipdate)) AS s, epoch(min(l_shipdate)) + 86400 * 2 AS e FROM lineitem GROUP BY l_suppkey)
SELECT c, k FROM o JOIN l ON o.s <= l.e AND l.s <= o.e
"""


@query(_SPANS)
def join_overlaps_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' spans of orders and the first two days of suppliers' shipments that they overlap. Both are read several times, so they are written once."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    starts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.min("l_shipdate").alias("a"))
    left = spans.select("c", seconds("a").alias("start"), seconds("b").alias("end"))
    right = starts.select("k", seconds("a").alias("start"), (seconds("a") + 2 * 86400).alias("end"))
    return join_overlaps(round_trip(left, "parquet"), round_trip(right, "parquet")).select("c", "k")
