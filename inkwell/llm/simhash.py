"""SimHash near-dedup with Golay-code fuzzy keys.

The fingerprint of a text has 64 bits; two texts are linked if theirs differ in
at most 3. It is cut into segments of 23, 23 and 18 bits. Of at most 3 errors,
some two segments have at most one each (pigeonhole), so each pair of segments
is looked up. A segment is read as a word of the perfect binary Golay code
[23, 12, 7]: the index of the nearest codeword is its own key, and the indices
that appear when one of its bits is flipped are its nearby keys (1 key within
distance 2 of the codeword, up to 6 at distance 3). Segments with at most one
error agree on u's own key and one of v's keys, so for each pair of segments
(a, b) one side has (own key of a, every key of b) and the other (every key of
a, own key of b): an equi-join on 24 bits, then the distance is verified.

Only different fingerprints are joined, and components are found on them, so
exact copies cost one row for each. Components: alternating large-star and
small-star steps over the edge table until it no longer changes.

Edge cases: null, empty and wordless texts have fingerprint zero, linked like
any other; a text of one or two words has one shingle, the whole; a row without
doc_id gets the component of its fingerprint, whose id is the smallest one
there is (null if there is none); rows that repeat an id are kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, saved, small_side

SEGMENTS = ((0, 23), (23, 23), (46, 18))  # offset, bits
MAX_DISTANCE = 3
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    h = shingle_hashes(text, size, seed)
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        bits = np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and the fingerprint as a signed long of each document."""

    def run(batches):
        for batch in batches:
            out = [fingerprint(t or b"", shingle, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            prints = pa.array(np.array(out, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    unit = [remainder(1 << k) for k in range(23)]
    low, high = np.zeros(4096, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for k in range(12):
        low[1 << k : 2 << k] = low[: 1 << k] ^ unit[k]
    for k in range(11):
        high[1 << k : 2 << k] = high[: 1 << k] ^ unit[12 + k]
    error = np.zeros(2048, dtype=np.int64)
    for a in range(23):
        error[unit[a]] = 1 << a
        for b in range(a):
            error[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return low, high, error


def golay_index(word: np.ndarray) -> np.ndarray:
    """Index 0..4095 of the codeword nearest to each 23-bit word."""
    low, high, error = _golay()
    return (word ^ error[low[word & 4095] ^ high[word >> 12]]) >> 11


def segment_keys(word: np.ndarray, bits: int) -> np.ndarray:
    """Rows of keys: the own one, then the one after each bit is flipped."""
    return np.stack([golay_index(word), *(golay_index(word ^ (1 << k)) for k in range(bits))], axis=1)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and side (0: own key of the first segment, 1: of the second) of each key."""
    own = [(prints >> o) & ((1 << b) - 1) for o, b in SEGMENTS]
    keys = [segment_keys(w, b) for w, (_, b) in zip(own, SEGMENTS, strict=True)]
    rows, out, sides = [], [], []
    for tag, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        for side, key in ((0, keys[a][:, :1] << 12 | keys[b]), (1, keys[a] << 12 | keys[b][:, :1])):
            key = np.sort(key, axis=1)
            new = np.ones(key.shape, dtype=bool)
            new[:, 1:] = key[:, 1:] != key[:, :-1]
            i, j = np.nonzero(new)
            rows.append(i)
            out.append(key[i, j] | tag << 24)
            sides.append(np.full(len(i), side))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(sides)


def links(prints: DataFrame) -> DataFrame:
    """Pairs a < b of different fingerprints (column fp, no repeats) at distance 1 to 3."""

    def run(frames):
        for pdf in frames:
            fp = pdf["fp"].to_numpy()
            row, key, side = fuzzy_keys(fp.view(np.uint64).astype(np.int64) if fp.dtype != np.int64 else fp)
            yield pd.DataFrame({"key": key, "side": side.astype("int8"), "fp": fp[row]})

    keyed = prints.select("fp").mapInPandas(run, "key int, side byte, fp long")
    a = keyed.filter("side = 0").select("key", F.col("fp").alias("x"))
    b = keyed.filter("side = 1").select("key", F.col("fp").alias("y"))
    near = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_DISTANCE)
    return a.join(b, (a["key"] == b["key"]) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges (a, b)."""
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        # Large star: every larger neighbour of u goes to u's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def groups(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of each document."""
    prints = saved(fingerprints(docs, shingle, seed), "prints")
    unique = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    linked = components(links(unique))
    known = unique.join(linked, unique["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of docs with one of each component: the one of the smallest
    doc_id (null ids last), of equal ids the one with the smallest hash of the
    text, then of the whole row; of rows equal in all columns any one."""
    base = packed(docs).withColumn("_w", F.hash("_row") if "map<" not in docs.schema.simpleString() else F.col("_h"))
    prints = saved(fingerprints(base.select(F.struct("_id", "_h", "_w").alias("doc_id"), F.col("_text").alias("text")), shingle), "prints")
    unique = saved(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id._id").isNull(), "doc_id.*")).alias("first")), "unique")
    linked = components(links(unique))
    known = unique.join(linked, unique["fp"] == linked["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    named = lambda df: df.withColumnsRenamed({"_id": "_i", "_h": "_k", "_w": "_v"})
    same = lambda other: (base["_h"] == other["_k"]) & (base["_w"] == other["_v"]) & base["_id"].eqNullSafe(other["_i"])
    first = known.groupBy("root").agg(F.min("first").alias("first")).select("first._id", "first._h", "first._w")
    first = named(small_side(saved(first, "first")))
    kept = base.join(first, same(first), "left_semi")
    often = saved(named(prints.select("doc_id.*")).groupBy("_i", "_k", "_v").count().filter("count > 1").drop("count"), "often")
    if not often.isEmpty():
        often = small_side(often)
        one = kept.join(often, same(often), "left_semi").groupBy("_id", "_h", "_w").agg(F.first("_row").alias("_row"))
        kept = kept.join(often, same(often), "left_anti").select("_row").unionByName(one.select("_row"))
    return kept.select("_row.*")
