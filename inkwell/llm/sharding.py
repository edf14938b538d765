"""Sharding by a Feistel permutation of global row numbers.

Documents are numbered 0..n-1 in the order of doc_id. A keyed Feistel network
permutes the smallest even power of two that holds n, and cycle walking (apply
it again while the result is n or more) makes that a permutation of 0..n-1.
Position p goes to shard p mod s, slot p div s. So a shuffle is reproducible
from (seed, n) alone, shard and slot of a row number are computed without
looking at any other row, and ``row_of`` goes back. Shards differ by one row
at most (law ``rows``).

Edge cases: null ids are numbered first; rows that repeat an id are ordered by
crc32 and size of the text, and rows equal in these are interchangeable; null
and empty texts have size 8 and crc32 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved

ROUNDS = 6
SEED = 20240607


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left ^ key) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ key) & mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Position of each row number in 0..n-1, or with back the row number of each position."""
    x = np.asarray(rows).astype(np.uint64)
    if not len(x):
        return x.astype(np.int64)
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys, size = _keys(seed), np.uint64(n)
    with np.errstate(over="ignore"):
        x = _network(x, half, keys, back)
        while len(out := np.flatnonzero(x >= size)):
            x[out] = _network(x[out], half, keys, back)
    return x.astype(np.int64)


def place(rows: np.ndarray, n: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    position = permute(rows, n, seed)
    return position % shards, position // shards


def row_of(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number that has this place."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with its global row number ``_row`` in the given order, and its count.

    A range exchange sorts; each row's place in its partition is kept with the
    table, so that only one count for each partition has to be added up."""
    spot = (
        df.repartitionByRange(*[F.asc_nulls_first(c) for c in order])
        .sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
        .withColumn("_spot", F.monotonically_increasing_id())
    )
    spot = saved(spot, "numbered")
    part = F.shiftright("_spot", 33)
    counts = spot.groupBy(part.alias("_part")).count()  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    row = F.col("_start") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    out = spot.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_row", row)
    return out.drop("_part", "_start", "_spot"), spot.count()


def shard(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    base = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    rows, n = numbered(base, "doc_id", "text_crc32", "size")

    @F.pandas_udf(T.LongType())
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return rows.withColumn("_at", position("_row")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_at") % shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_row").alias("row_number"),
    )
