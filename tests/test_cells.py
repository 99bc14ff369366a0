"""The index by cells against the exact way: equal when all cells are probed, recall when few are."""

import os
import re

import numpy as np
import pytest

from plumbline.operators import cells, retrieval

TABLES = "/root/testdata/sf0.1"


def frames(spark, x, asked):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    return vectors, spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<float>")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def clustered():
    r = np.random.default_rng(2)
    middle = r.standard_normal((30, 16))
    return (middle[r.integers(0, 30, 1500)] + 0.25 * r.standard_normal((1500, 16))), middle[:12] + 0.25 * r.standard_normal((12, 16))


def recall(found, exact):
    pairs = lambda df: {(r[0], r[1]) for r in rows(df)}
    exact = pairs(exact)
    return len(pairs(found) & exact) / len(exact)


def test_all_cells_give_the_exact_rows(spark, tmp_path, clustered):
    vectors, queries = frames(spark, *clustered)
    index = cells.CellIndex(spark, str(tmp_path / "i")).build(vectors)
    assert rows(index.search(queries, probes=10_000)) == rows(retrieval.vector_arm(vectors, queries))
    assert rows(index.search(queries, n=3, probes=10_000, block=5)) == rows(retrieval.vector_arm(vectors, queries, 3))


def test_recall_of_few_probes_on_clusters(spark, tmp_path, clustered):
    vectors, queries = frames(spark, *clustered)
    index = cells.CellIndex(spark, str(tmp_path / "i")).build(vectors)
    middle, probes = index.heads()
    assert probes < len(middle) / 4
    assert recall(index.search(queries), retrieval.vector_arm(vectors, queries)) >= 0.9
    plan = index.search(queries.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan) or re.search(r"PartitionFilters: \[[^\]]*cell#\d+ =", plan)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_recall_on_vectors_without_clusters(spark, tmp_path):
    """The index finds out by itself that it has to probe most cells."""
    t = spark.read.parquet(f"{TABLES}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    queries = t.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = cells.CellIndex(spark, str(tmp_path / "i")).build(t)
    assert recall(index.search(queries), retrieval.vector_arm(t, queries)) >= 0.9


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    data = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [0.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    vectors = spark.createDataFrame(data, "id long, vector array<float>")
    queries = vectors.where("id is not null").withColumnRenamed("id", "query_id")
    index = cells.CellIndex(spark, str(tmp_path / "i")).build(vectors)
    found = [(r["query_id"], r["id"], r["distance"]) for r in index.search(queries, probes=99).collect()]
    assert sorted(found) == sorted((q, i, d) for q, near in ((1, ((1, 0), (8, 0), (8, 0), (7, 1))), (8, ((1, 0), (8, 0), (8, 0), (7, 1))), (7, ((7, 0), (1, 1), (8, 1), (8, 1)))) for i, d in near)
    none = cells.CellIndex(spark, str(tmp_path / "none")).build(vectors.limit(0))
    assert none.search(queries).count() == 0 and index.search(queries.limit(0)).count() == 0


def test_the_exact_way_with_ids_that_are_strings(spark):
    data = [("b", [1.0, 0.0]), ("aa", [1.0, 0.0]), ("é", [0.0, 1.0]), (None, [1.0, 0.0]), ("z", None)]
    vectors = spark.createDataFrame(data, "id string, vector array<float>")
    for block in (1, 10):
        found = retrieval.vector_arm(vectors, vectors.withColumnRenamed("id", "query_id"), 2, block=block).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["id"], r["distance"]) for r in found] == [("aa", "aa", 0), ("aa", "b", 0), ("b", "aa", 0), ("b", "b", 0), ("é", "é", 0), ("é", "aa", 1)]
    numbers = vectors.selectExpr("CAST(length(id) AS INT) AS id", "vector").where("id = 2")
    assert retrieval.vector_arm(numbers, numbers.withColumnRenamed("id", "query_id")).schema["id"].dataType.simpleString() == "int"
