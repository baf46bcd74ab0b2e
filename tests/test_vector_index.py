"""The stored vector index."""

import numpy as np
import pytest

from ledgerloom.operators import vector_index
from ledgerloom.operators.search import vector_topk
from ledgerloom.operators.vector_index import VectorIndex, recall
from ledgerloom.session import work_path


def frame(spark, x, kind="float"):
    rows = [(f"c{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"id string, content_vector array<{kind}>").repartition(5)


def asked(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "query_id int, vector array<double>")


def clusters(seed, n, width=32, centres=60, spread=0.6):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(centres, width))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))


def test_recall_and_exact_scores(spark):
    vectors = frame(spark, clusters(1, 6000))
    queries = asked(spark, clusters(2, 100))
    index = VectorIndex(spark, work_path(spark, "ivf")).build(vectors)
    assert recall(index, vectors, queries) >= 0.9
    assert recall(index, vectors, queries, probes=1) < recall(index, vectors, queries)
    exact = {(r.query_id, r.id): r.score for r in vector_topk(vectors, queries, 10).collect()}
    rows = index.search(queries).collect()
    for r in rows:
        if (r.query_id, r.id) in exact:
            assert r.score == pytest.approx(exact[r.query_id, r.id], abs=2e-6)
    assert len(rows) == 1000 and {r["rank"] for r in rows} == set(range(1, 11))


def test_vectors_without_clusters(spark):
    rng = np.random.default_rng(5)
    vectors, queries = frame(spark, rng.normal(size=(2000, 16))), asked(spark, rng.normal(size=(50, 16)))
    index = VectorIndex(spark, work_path(spark, "ivf")).build(vectors)
    assert recall(index, vectors, queries) >= 0.9


def test_recall_on_the_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.filter("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    index = VectorIndex(spark, work_path(spark, "ivf")).build(vectors, "vec_id", "embedding")
    assert recall(index, vectors, queries, 10, "vec_id", "embedding") >= 0.9


def test_cells_that_are_not_probed_are_not_read(spark):
    index = VectorIndex(spark, work_path(spark, "ivf")).build(frame(spark, clusters(3, 1500)), cells=30)
    query = clusters(4, 1)
    probed = []
    cells = VectorIndex._cells

    def spied(self, wanted, columns):
        rows = cells(self, wanted, columns)
        probed.append((set(wanted), rows))
        return rows

    VectorIndex._cells = spied
    try:
        assert index.search(asked(spark, query), probes=4).count() == 10
    finally:
        VectorIndex._cells = cells
    assert [len(wanted) for wanted, _ in probed] == [4, 4]
    for wanted, rows in probed:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell" in plan
        files = {row[0] for row in rows.selectExpr("_metadata.file_path").distinct().collect()}
        assert {int(f.split("cell=")[1].split("/")[0]) for f in files} <= wanted
    assert "vector" not in probed[0][1].columns


def test_the_books_come_back_from_the_manifest(spark):
    path, vectors = work_path(spark, "ivf"), frame(spark, clusters(6, 800))
    queries = asked(spark, clusters(7, 10))
    first = VectorIndex(spark, path).build(vectors).search(queries).collect()
    again = VectorIndex(spark, path)
    assert again.search(queries).collect() == first
    assert sum(again._cells(range(100), ["id"]).groupBy("id").count().select("count").toPandas()["count"]) == 800


def test_odd_vectors_and_empty_tables(spark):
    rows = [("a", [1.0, 0.0, 0.5]), ("b", [1.0, 0.0, 0.5]), ("none", None), ("zero", [0.0] * 3), ("short", [1.0]),
            ("hole", [None, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id string, content_vector array<float>")
    index = VectorIndex(spark, work_path(spark, "ivf")).build(vectors)
    got = index.search(asked(spark, [[1.0, 0.0, 0.5]])).collect()
    assert [(r.id, r.score, r["rank"]) for r in got] == [("a", 1.0, 1), ("b", 1.0, 2)]
    assert index.search(asked(spark, [[1.0, 0.0, 0.5]]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        index.search(asked(spark, [[1.0]]))
    empty = VectorIndex(spark, work_path(spark, "ivf")).build(vectors.limit(0))
    assert empty.search(asked(spark, [[1.0]])).count() == 0


def test_kmeans_fills_empty_centres():
    x = np.repeat(np.eye(4), 5, axis=0)
    centres = vector_index._kmeans(x, 4, np.random.default_rng(1))
    assert sorted(map(tuple, centres.round(6))) == sorted(map(tuple, np.eye(4)))
