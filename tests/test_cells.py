"""Search by cells against the exact search."""

from __future__ import annotations

import numpy as np
import pytest

from inkwell.operators import cells, retrieval
from inkwell.plans import registry


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    path = f"/root/testdata/sf{sf}"
    found, exact = (registry.QUERIES[q](spark, path) for q in ("wn01_cells_topk", "wn01_dense_topk"))
    assert cells.recall(found, exact, "query_id", "vec_id") >= 0.9 and found.count() == exact.count()


def test_all_cells_are_exact(spark):
    rnd = np.random.default_rng(5)
    middle = rnd.normal(size=(6, 8))
    made = [(i, (middle[i % 6] + 0.3 * rnd.normal(size=8)).tolist()) for i in range(600)] + [(1000 + i, middle[0].tolist()) for i in range(300)]  # a vector that many rows have
    vectors = spark.createDataFrame([*made, (5000, None), (5001, [1.0]), (5002, [0.0] * 8)], "id long, v array<double>").repartition(4)
    queries = vectors.filter("id % 50 = 0").withColumnRenamed("id", "q")
    index = cells.build(vectors, "id", 6)
    assert index.table.count() == 901 and 1 < len(index.centres) <= 6
    exact = rows(retrieval.dense(vectors, queries.filter("size(v) = 8"), "id", "q", 7), "q", "rank", "id", "score")
    assert rows(cells.search(index, queries, "q", 7, probes=6), "q", "rank", "id", "score") == exact
    one = cells.search(index, queries, "q", 7, probes=1)
    assert cells.recall(one, cells.search(index, queries, "q", 7, probes=6), "q", "id") > 0.5
    lone = queries.filter("q = 0")
    plan = cells.search(index, lone, "q", 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    index = cells.build(empty, "id")
    assert cells.search(index, empty.withColumnRenamed("id", "q"), "q").count() == 0
