"""Centroid clustering of vectors with Hamerly's bounds, in exact integers.

Each component x becomes floor(``SCALE`` * x). A vector keeps its centroid, an
upper bound of its distance to it and a lower bound of its distance to every
other. When centroids move, the upper bound grows by its own centroid's way and
the lower one shrinks by the farthest way of another, so a vector whose upper
bound is under the lower one, or under half the distance from its centroid to the
next, stays where it is unseen. For the others the upper bound is made exact;
those still in doubt get a full scan in 64-bit integers (ties: smaller number).
Bounds are floating point and loosened by more than rounding can amount to, and
only a strict order spares a scan, so results equal those of scanning all.

Bounds and centroid are written with the vectors after each round, so a lost
executor repeats a part of one round. New centroids come from running sums, to
which a round adds the vectors that moved in and takes off those that moved out:
a row for each centroid comes to the driver, whatever the input.

Edge cases: vectors that are null, of another size, or with a component that is
null, NaN or infinite are left out; null ids come last when centroids are chosen
and repeated ids are rows of their own, in the order of their components; with
fewer vectors than centroids each vector starts one; equal vectors and ties go to
the smaller number; a centroid that loses all vectors stays where it is; an empty
table gives an empty result. Components of 2^27 and more (after scaling) raise an
error, as their distances overflow 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, saved_at

SCALE, CENTROIDS, ROUNDS, DIMS = 256, 40, 5, 64
LIMIT = 1 << 27
SLACK = 1e-12  # of a bound, at each change: thousands of times the rounding of a double
BLOCK = 4096  # vectors scanned at a time
STATE = "vec_id {id}, v array<int>, cluster int, before int, upper double, lower double, distance long"


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer components of the vectors that count."""
    x = F.transform(vectors["embedding"], lambda c: c.cast("double"))
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    far = F.raise_error(F.lit(f"component beyond {LIMIT} after scaling")).cast("int")
    number = lambda c: F.when(F.abs(c * scale) < LIMIT, F.floor(c * scale).cast("int")).otherwise(far)
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(vectors["vec_id"], F.transform(x, number).alias("v"))


def seeds(points: DataFrame, centroids: int, salt: str = "2") -> np.ndarray:
    """The components of the first centroids: a bounded number of rows, in the order of a hash of the id."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select("v", by.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(centroids).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def squared(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each vector."""
    return (v * v).sum(1)[:, None] - 2 * (v @ centres.T) + (centres * centres).sum(1)[None, :]


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid by a full scan, its squared distance and that of the next one (infinite if there is none)."""
    own, first, second = np.empty(len(v), np.int32), np.empty(len(v), np.int64), np.full(len(v), np.inf)
    for a in range(0, len(v), BLOCK):
        d = squared(v[a : a + BLOCK], centres)
        at = d.argmin(1)
        rows = np.arange(len(d))
        own[a : a + BLOCK], first[a : a + BLOCK] = at, d[rows, at]
        if len(centres) > 1:
            d[rows, at] = np.iinfo(np.int64).max
            second[a : a + BLOCK] = d.min(1)
    return own, first, second


class Moved:
    """What the last change of the centroids says about all bounds."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.way = np.sqrt(((new - old) ** 2).sum(1).astype(float))
        far = np.argsort(-self.way, kind="stable")
        # The farthest way of another centroid than one's own.
        self.other = np.full(len(new), self.way[far[0]])
        self.other[far[0]] = self.way[far[1]] if len(new) > 1 else 0.0
        apart = squared(new, new).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(1)) / 2 * (1 - SLACK)


def assign(v, cluster, upper, lower, centres: np.ndarray, moved: Moved | None):
    """The new cluster, upper and lower bound of each vector, and how many were scanned. moved: None scans all."""
    if moved is None:
        doubt = np.arange(len(v))
        cluster, upper, lower = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
    else:
        way, other = moved.way[cluster], moved.other[cluster]
        upper = (upper + way) * (1 + SLACK)
        lower = lower - other - (lower + other) * SLACK if len(centres) > 1 else np.full(len(v), np.inf)
        safe = np.maximum(lower, moved.half[cluster])
        doubt = np.flatnonzero(~(upper < safe))
        exact = ((v[doubt] - centres[cluster[doubt]]) ** 2).sum(1)
        upper[doubt] = np.sqrt(exact.astype(float)) * (1 + SLACK)
        doubt = doubt[~(upper[doubt] < safe[doubt])]
    own, first, second = nearest(v[doubt], centres)
    cluster = cluster.copy()
    cluster[doubt] = own
    upper[doubt] = np.sqrt(first.astype(float)) * (1 + SLACK)
    lower[doubt] = np.sqrt(second) * (1 - SLACK)
    return cluster, upper, lower, len(doubt)


def step(state: DataFrame, centres: np.ndarray, moved: Moved | None, last: bool) -> DataFrame:
    """The state after one assignment; the last one has the distances in place of vectors and bounds."""
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            before = get("cluster").astype(np.int32) if moved else np.full(n, -1, np.int32)
            bounds = (get("upper").copy(), get("lower").copy()) if moved else (None, None)
            cluster, upper, lower, _ = assign(v, before, *bounds, centres, moved)
            if last:
                distance, blank = ((v - centres[cluster]) ** 2).sum(1), pa.nulls(n)
                cols = [blank.cast(pa.list_(pa.int32())), pa.array(cluster), pa.array(before), blank.cast(pa.float64()), blank.cast(pa.float64()), pa.array(distance)]
            else:
                cols = [batch.column("v"), pa.array(cluster), pa.array(before), pa.array(upper), pa.array(lower), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *cols], names=["vec_id", "v", "cluster", "before", "upper", "lower", "distance"])

    return state.mapInArrow(run, STATE.format(id=kind))


def gained(state: DataFrame, dims: int, centroids: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors and component sums that each centroid has gained by the last assignment."""
    each = state.filter("cluster <> before").select("v", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("s")), F.struct(F.col("before").alias("c"), F.lit(-1).cast("long").alias("s")))).alias("e"))
    sums = each.filter("e.c >= 0").groupBy("e.c").agg(F.sum("e.s").alias("n"), *(F.sum(F.get("v", F.lit(i)) * F.col("e.s")).alias(f"s{i}") for i in range(dims)))
    counts, totals = np.zeros(centroids, dtype=object), [[0] * dims for _ in range(centroids)]
    for r in sums.collect():  # a row for each centroid
        counts[r[0]], totals[r[0]] = r[1], list(r[2:])
    return counts, totals


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of each kept vector after ``rounds`` rounds and a last assignment, and the final centroids."""
    spark = vectors.sparkSession
    state, path = saved_at(kept(vectors, dims, scale), "vectors")
    centres = seeds(state, centroids)
    if not len(centres):
        return state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), centres.reshape(0, dims)
    moved, counts, totals = None, np.zeros(len(centres), dtype=object), np.zeros((len(centres), dims), dtype=object)
    for k in range(rounds + 1):
        done, old = saved_at(step(state, centres, moved, k == rounds), "assigned")
        remove(spark, path)
        state, path = done, old
        if k < rounds:
            n, s = gained(state, dims, len(centres))
            counts, totals = counts + n, totals + np.array(s, dtype=object)
            new = centres.copy()
            for c in range(len(centres)):
                if counts[c]:
                    new[c] = [t // counts[c] for t in totals[c]]
            moved, centres = Moved(centres, new), new
    return state.select("vec_id", "cluster", "distance"), centres


def digests(vectors: DataFrame) -> DataFrame:
    found, centres = cluster(vectors)
    spark = vectors.sparkSession
    sums = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row for each centroid
    total = sum(sums.values())
    told = [(c, sums[c], total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c in sorted(sums)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
