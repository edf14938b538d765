"""Dense search by cells: vectors lie by their nearest of a few centroids, and a query looks into the nearest cells only.

Centroids are fitted on a bounded sample (SAMPLE vectors by a hash of their key); every vector is in the table, under a
folder for its cell, so a search reads the folders of the cells that are probed. retrieval.dense() is the exact way."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved_under
from .retrieval import blocks, top, unit

CELLS, SAMPLE, ITERATIONS = 100, 8192, 12
#: What the number of probes is chosen for: the share of TUNED neighbours of so many vectors of the sample that is found.
RECALL, TUNED, ASKED = 0.95, 5, 256


@dataclass(frozen=True)
class Cells:
    """The table (key, v, cell), the centroids, of unit length, and how many cells a query needs."""

    table: DataFrame
    centres: np.ndarray
    key: str
    probes: int


def fit(vectors: DataFrame, key: str, cells: int = CELLS, sample: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, int]:
    """Centroids of unit length, by k-means on a sample of vectors (key, v) of one dimension, at least a few dozen vectors for
    each; and the cells to probe for RECALL among the sample. Neighbours among all vectors are nearer, so more of them are found."""
    rows = vectors.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(sample).select("v").collect()
    if not rows:
        return np.zeros((0, 0)), 0
    x = unit(np.array([r[0] for r in rows], dtype=np.float64))
    centres = x[np.random.default_rng(seed).permutation(len(x))[: max(1, min(cells, len(x) // 24))]]
    for _ in range(ITERATIONS):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where((sums * sums).sum(1, keepdims=True) > 0, unit(sums), centres)
    near, asked = (x @ centres.T).argmax(1), x[:ASKED]
    close = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : TUNED + 1]  # itself too
    turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(turn, near[close], axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1


def build(vectors: DataFrame, key: str, cells: int = CELLS, sample: int = SAMPLE) -> Cells:
    """The cells of vectors (key, v). Vectors that are null or not of the most common dimension of the table are no candidates."""
    sizes = vectors.filter("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kept = vectors.select(key, "v").filter(F.size("v") == (sizes[0] if sizes else 0))
    centres, probes = fit(kept, key, cells, sample)

    def nearest(v: pa.Array) -> pa.Array:
        x = unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1))
        return pa.array((x @ centres.T).argmax(1).astype(np.int32))

    placed = kept.withColumn("cell", F.arrow_udf(nearest, "int")("v") if len(centres) else F.lit(0))
    return Cells(saved_under(placed, "cells", "cell"), centres, key, probes)


def search(index: Cells, queries: DataFrame, query: str, k: int = 5, probes: int | None = None) -> DataFrame:
    """query, key, score and rank of the best k vectors in the cells nearest to each of queries (query, v): ``probes`` of them, or as many as the index says.

    Queries come in blocks of a bounded size; each task keeps its best k of a query, so only these are exchanged."""
    spark, key, probes = index.table.sparkSession, index.key, index.probes if probes is None else probes
    kinds = (queries.schema[query].dataType.simpleString(), index.table.schema[key].dataType.simpleString())
    out = None
    for rows in blocks(queries.select(query, "v").filter(F.size("v") == (index.centres.shape[1] if len(index.centres) else 0)), query):
        matrix = unit(np.array([r["v"] for r in rows], dtype=np.float64))
        near = np.argsort(-(matrix @ index.centres.T), axis=1, kind="stable")[:, :probes]
        of_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast(([r[query] for r in rows], matrix, of_cell))

        def run(batches, shared=shared):
            ids, matrix, of_cell = shared.value
            best: dict[int, list[tuple[float, object]]] = {}
            for batch in batches:
                names, cell = batch.column(0).to_pylist(), batch.column(2).to_numpy()
                there = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1))
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    score = np.round(matrix[of_cell[c]] @ there[at].T, 9)
                    for q, row in zip(of_cell[c].tolist(), score, strict=True):
                        least = np.partition(row, -k)[-k] if len(row) > k else -2.0
                        best[q] = sorted([*best.get(q, []), *((-row[i], names[at[i]]) for i in np.flatnonzero(row >= least).tolist())])[:k]
            rows = [(ids[q], name, -s) for q, own in best.items() for s, name in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[query + "_", key, "score"])

        there = index.table.filter(F.col("cell").isin(list(of_cell))).select(key, "v", "cell")
        got = there.mapInArrow(run, f"{query}_ {kinds[0]}, {key} {kinds[1]}, score double").withColumnRenamed(query + "_", query)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.sql(f"SELECT CAST(NULL AS {kinds[0]}) AS {query}, CAST(NULL AS {kinds[1]}) AS {key}, 0.0D AS score").limit(0)
    return top(out, query, k, F.desc("score"), key)


def recall(found: DataFrame, exact: DataFrame, query: str, key: str) -> float:
    """The share of the exact best that was found."""
    n = exact.count()
    return exact.join(found, [query, key], "left_semi").count() / n if n else 1.0
