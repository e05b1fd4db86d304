"""Range joins against plain loops: nulls, ends that meet, long intervals, a bin with nearly all points; and their plans."""

import random

import pytest

from millrace.operators.intervals import join_overlaps, join_points
from millrace.registry import QUERIES


def made(seed, n, heavy=0):
    rng = random.Random(seed)
    points = [(k, rng.choice([None, float(rng.randint(-50, 50)), rng.uniform(-50, 50)])) for k in range(n)] + [(n + k, 7.25) for k in range(heavy)]
    spans = []
    for k in range(n // 2):
        start = rng.choice([float(rng.randint(-60, 60)), rng.uniform(-60, 60), 7.25])
        spans.append((k, start, rng.choice([start, start + 1, start + rng.uniform(0, 5), start + 1000, start - 1, None])))
    return points, spans


@pytest.mark.parametrize("part", [3, 4096])
@pytest.mark.parametrize("seed", range(2))
def test_points(spark, seed, part):
    points, spans = made(seed, 60, heavy=40)
    found = join_points(spark.createDataFrame(points, "p long, at double"), spark.createDataFrame(spans, "k long, start double, end double"), part)
    expected = sorted((p, k) for p, at in points for k, s, e in spans if at is not None and e is not None and s <= at <= e)
    assert sorted((r["p"], r["k"]) for r in found.collect()) == expected and len(expected) > 100


@pytest.mark.parametrize("seed", range(2))
def test_overlaps(spark, seed):
    left, right = made(seed, 80)[1], [(k, s, e) for k, s, e in made(seed + 9, 60)[1]]
    found = join_overlaps(spark.createDataFrame(left, "k long, start double, end double"), spark.createDataFrame(right, "j long, start double, end double"), 5)
    fit = lambda s, e: e is not None and s <= e
    expected = sorted((k, j) for k, s, e in left for j, a, b in right if fit(s, e) and fit(a, b) and s <= b and a <= e)
    assert sorted((r["k"], r["j"]) for r in found.collect()) == expected and len(expected) > 50


def test_empty_sides(spark):
    points, spans = spark.createDataFrame([(1, 2.0)], "p long, at double"), spark.createDataFrame([(1, 1.0, 3.0)], "k long, start double, end double")
    assert join_points(points.limit(0), spans).count() == 0 and join_points(points, spans.limit(0)).count() == 0
    assert join_points(points, spans).count() == 1


def test_one_heavy_bin_is_split(spark):
    """Ten parts of nearly equal points meet each a copy of the interval; every pair is made once."""
    points = spark.range(10_000).selectExpr("id p", "5.0D at")
    spans = spark.createDataFrame([(1, 4.0, 6.0), (2, 5.0, 5.5)], "k long, start double, end double")
    found = join_points(points, spans, part=1000)
    assert found.count() == 20_000 and found.distinct().count() == 20_000


@pytest.mark.parametrize("name", ["join_range_pairs", "join_overlaps_spans"])
def test_no_nested_loop(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan


def test_numbers_that_are_not_finite(spark):
    points = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "p long, at double")
    spans = spark.createDataFrame([(1, 0.0, float("inf")), (2, float("nan"), 2.0), (3, 1.0, 1.0)], "k long, start double, end double")
    assert [tuple(r) for r in join_points(points, spans).select("p", "k").collect()] == [(3, 3)]


def test_a_full_bin_is_a_grid_of_bounded_cells(spark):
    """Both sides are dealt, into CELLS cells at most, so copies don't grow with the product of the sides; every pair is made once."""
    from millrace.operators import intervals

    points = spark.range(3000).selectExpr("id p", "5.0D + id % 7 / 10 at")
    spans = spark.range(2000).selectExpr("id k", "5.0D start", "5.3D + id % 3 / 10 end")
    grid = intervals._full(points.selectExpr("*", "1.0D width", "0L bin"), spans.selectExpr("*", "1.0D width", "0L bin"), 10).collect()
    assert [tuple(r) for r in grid] == [(1.0, 0, 10, 6)] and 10 * 6 <= intervals.CELLS
    found = join_points(points, spans, part=10).groupBy("p", "k").count()
    expected = sum(5.0 + p % 7 / 10 <= 5.3 + k % 3 / 10 for p in range(3000) for k in range(2000))
    assert found.count() == expected and found.where("count > 1").isEmpty()
    few = spark.range(2).selectExpr("id k", "5.0D start", "6.0D end", "1.0D width", "0L bin")
    assert [tuple(r) for r in intervals._full(points.selectExpr("*", "1.0D width", "0L bin"), few, 10).collect()] == [(1.0, 0, 64, 1)]
