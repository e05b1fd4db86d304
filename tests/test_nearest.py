"""Exact search whatever the blocks, and the index's recall against it."""

import numpy as np
import pytest
from compare import rows

import __spark_entry__  # noqa: F401  registers the queries
from millrace.functions.vectors import Index, centres, nearest, recall
from millrace.registry import QUERIES, SQL


@pytest.mark.parametrize("sizes", [(7, 2), (10_000, 10_000)])
def test_blocks_give_the_same_rows(spark, duck, sf_dir, sizes):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(3)
    found = nearest(vectors, vectors.where("vec_id % 100 = 0"), sizes=sizes)
    assert rows(found.toPandas()) == rows(duck.sql(SQL["fn_nearest_vectors"]).df())


def test_ties_go_to_the_smallest_id(spark):
    vectors = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(40, 0, -1)] + [(100, [1.0, 0.0])], "vec_id long, embedding array<float>").repartition(4)
    found = nearest(vectors, vectors.where("vec_id = 100"), sizes=(7, 5)).toPandas()
    assert sorted(found["other"]) == [1, 2, 3, 4, 5] and np.allclose(found["cosine"], 1)


def test_vectors_without_direction(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 1.0]), (100, None)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 100 = 0")
    for found in (nearest(vectors, queries), Index(vectors).search(queries)):
        assert [(r["vec_id"], r["other"], r["cosine"]) for r in found.collect()] == [(0, 4, 0.707107)]


def test_no_queries_and_no_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert nearest(vectors, vectors.where("vec_id = 0")).count() == 0
    assert Index(vectors.limit(0)).search(vectors).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_index(spark, sf_dir, sf):
    """At least 0.9 of the exact neighbours over the tables, and every vector is in a list."""
    folder = sf_dir.replace("sf0.001", sf)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    index = Index(vectors)
    assert index.lists.count() == vectors.count()
    queries = vectors.where("vec_id % 100 = 0")
    assert recall(index.search(queries), nearest(vectors, queries)) >= 0.9
    assert recall(index.search(queries, probes=len(index.centres)), nearest(vectors, queries)) == 1
    index.close()


def test_every_query_is_answered(spark):
    """Lists split into blocks, with more queries than a block holds."""
    made = spark.range(20_000).selectExpr("id vec_id", "array(cast(sin(id) as float), cast(cos(id) as float), cast(sin(id * 7) as float)) embedding")
    found = Index(made, sample=500, most=5).search(made.where("vec_id % 10 = 0"), k=3, probes=2, sizes=(900, 70)).toPandas()
    assert len(found) == 3 * 2000 and found["vec_id"].nunique() == 2000


def test_centres_of_few_directions():
    sample = np.repeat(np.eye(3), 5, axis=0)
    assert len(centres(sample, 10)) == 10 and np.allclose(np.linalg.norm(centres(sample, 3), axis=1), 1)
