"""The inverted-file index: recall against exact search, appends, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embedding, retrieval
from corpusloom.operators.vector_index import VectorIndex, fit_centroids, recall_of, unit_rows
from corpusloom.plans import knowledge


def test_recall_over_the_given_vectors(spark):  # noqa: ANN001
    """They are nearly uniform, so most cells are visited; what counts is that the measured probes hold the share."""
    d = "/root/testdata/sf0.01"
    q, v = knowledge._vectors(spark, d)
    exact = retrieval.semantic_seeds(q, v, embedding.RecallOptions.for_model(lexical=True))
    assert recall_of(knowledge.semantic_seeds_indexed(spark, d), exact) >= 0.95


def test_clustered_vectors_visit_few_cells(spark, tmp_path):  # noqa: ANN001
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 6
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, embedding array<double>")
    index = VectorIndex(f"file://{tmp_path}/index")
    index.build(items.where("id < 2000"), cells=32, sample=1000)
    index.append(items.where("id >= 2000"))
    assert spark.read.parquet(f"{index.path}/items").count() == 3000
    assert spark.read.parquet(f"{index.path}/meta").first()["probes"] <= 4
    q = items.where("id % 30 = 0").withColumnRenamed("id", "query_id")
    exact = embedding.nearest(q, items, 5, -1.0)
    assert recall_of(index.search(q, 5), exact) >= 0.95
    assert recall_of(index.search(q, 5, probes=32), exact) == 1.0


def test_odd_vectors(spark, tmp_path):  # noqa: ANN001
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.5, 0.1]), (1, [1.0, 0.0])]
    items = spark.createDataFrame(rows, "id int, embedding array<double>")
    index = VectorIndex(f"file://{tmp_path}/odd")
    index.build(items, cells=8)
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [0.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in index.search(q, 3, 0.5, probes=8).orderBy("rank").collect()] == [(10, 1), (10, 1), (10, 7)]
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex(f"file://{tmp_path}/none").build(items.where(F.lit(False)))


def test_centroids_are_all_used():
    x = unit_rows(np.repeat(np.eye(4), 25, axis=0).tolist())
    c = fit_centroids(x, 4)
    assert c.shape == (4, 4) and np.allclose((x @ c.T).max(axis=1), 1)
