"""Quality classifier: cumulative-link regression on graded ratings.

A text's score s is the sum of shared weights of its hashed features; ordered
thresholds t0 < t1 < ... turn it into grades: P(grade <= k) = 1 / (1 +
exp(s - t_k)). From these come the expected grade and the tail probability
P(grade >= top), by which documents are selected.

Features of a text are its different words, without case and outer punctuation,
the shape of words that hold symbols, and a few of the text as a whole: the
share of different words, of repeated neighbours and of repeated lines. The
grades of ``rated`` are 0 for toxic, 1 for poor, 2 for good texts.

The fit uses a bounded sample, one row for each id: ``sample`` rated documents,
taken in the order of a hash of doc_id, as far as they have ``features_most``
features (64 MB) in all. Every document is scored whole, however long.

Edge cases: a null or wordless text has expected grade 0 and tail probability
0; ratings with a null or unknown document train nothing; a document rated more
than once has the lowest of its grades, an id of several texts trains with the
least of them; without ratings everything has probability 0; a tail probability
of just ``at_least`` is kept; rows that repeat an id are scored each for
itself; columns besides doc_id and text (quality and toxic of the ratings) are
not looked at, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

BITS = 18
OUTER = b".,;:!?\"'()[]"
SYMBOLS = re.compile(rb"[^A-Za-z0-9.,;:!?\"'()\[\]\x80-\xff-]+")
CACHE = 400_000


def slot(feature: bytes) -> int:
    return xxhash.xxh32_intdigest(feature) & ((1 << BITS) - 1)


def word_slots(word: bytes) -> list[int]:
    shape = SYMBOLS.findall(word)
    core = SYMBOLS.sub(b"", word).strip(OUTER).lower()
    return ([slot(core)] if core else []) + [slot(b"\x00shape " + s[:3]) for s in shape]


def text_slots(text: bytes, words: list[bytes], different: int) -> list[int]:
    """Features of the whole text, as steps: each level reached is one more."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = {
        b"different": different / len(words),
        b"neighbours": sum(map(bytes.__eq__, words, words[1:])) / len(words),
        b"lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    level = {k: int(v * 10) for k, v in share.items()} | {b"size": len(words).bit_length()}
    return [slot(b"\x00%s %d" % (k, i)) for k, v in level.items() for i in range(v + 1)]


def slots(text: bytes) -> list[int]:
    words = text.split()
    if not words:
        return []
    each = set(words)
    return [i for w in each for i in word_slots(w)] + text_slots(text, words, len(each))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 120, penalty: float = 2e-4, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds, by Adam on the whole sample. Features of fewer
    than ``least`` rows get no weight: they would only be learnt by heart."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    often = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=1 << BITS) >= min(least, len(rows))
    flat, doc = flat[often[flat]], doc[often[flat]]
    # Texts of many words would else move much more than short ones.
    value = (1 / np.sqrt(np.log2(sizes + 2)))[doc]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades)) / len(grades), 0.01, 0.99)[:-1]
    logit = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(logit), 0.1))
    p = np.concatenate([np.zeros(1 << BITS), logit[:1], gaps])
    first, second, n = np.zeros_like(p), np.zeros_like(p), len(grades)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        w, cut = p[: 1 << BITS], np.cumsum(np.concatenate([p[1 << BITS :][:1], np.exp(p[(1 << BITS) + 1 :])]))
        s = np.bincount(doc, weights=w[flat] * value, minlength=n)
        edge = sigma(np.concatenate([[-np.inf], cut, [np.inf]])[None, :] - s[:, None])
        edge[:, 0], edge[:, -1] = 0, 1
        hi, lo = edge[np.arange(n), grades + 1], edge[np.arange(n), grades]
        ds = (1 - hi - lo) / n  # slope of the loss in s
        prob = np.maximum(hi - lo, 1e-9)
        dcut = np.zeros(n_grades - 1)
        np.add.at(dcut, np.minimum(grades, n_grades - 2), -np.where(grades < n_grades - 1, hi * (1 - hi) / prob, 0) / n)
        np.add.at(dcut, np.maximum(grades - 1, 0), np.where(grades > 0, lo * (1 - lo) / prob, 0) / n)
        tail = np.cumsum(dcut[::-1])[::-1]
        gw = np.bincount(flat, weights=ds[doc] * value, minlength=1 << BITS) + penalty * w
        g = np.concatenate([gw, tail[:1], tail[1:] * np.exp(p[(1 << BITS) + 1 :])])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p = p - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return p[: 1 << BITS].astype(np.float32), np.cumsum(np.concatenate([p[1 << BITS :][:1], np.exp(p[(1 << BITS) + 1 :])]))


class Weights(dict):
    """The weight of each raw word, worked out when first asked for."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight

    def __missing__(self, word: bytes) -> tuple[float, int]:
        own = word_slots(word)
        out = (float(self.weight[own].sum()) if own else 0.0, len(own))
        if len(self) > CACHE:
            self.clear()
        self[word] = out
        return out


def rated(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, grade and order of the sample: one row for each id, of repeated ids the least text."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.coalesce("toxic", "quality").isNotNull())
    order = F.xxhash64("doc_id").alias("_o")
    few = usable.groupBy("doc_id").agg(F.min(grade).alias("_g")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return met.groupBy("doc_id", "_g").agg(F.min("text").alias("text")).select("text", "_g", order, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 16000, features_most: int = 1 << 24, top: int = 2, at_least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top and kept of each document."""
    spark = docs.sparkSession

    def features(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            rows = [np.array(slots(t or b""), dtype="<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).cast(pa.int32()), batch.column(2)], names=["x", "g", "o"])

    known = saved(rated(docs, labels, sample).select("text", "_g", "_o").mapInArrow(features, "x binary, g int, o long"), "features").filter("octet_length(x) > 0")
    # At most ``sample`` sizes; those in the order of the hash whose features are within the bound come to the driver.
    sizes = np.array([tuple(r) for r in known.select("o", F.octet_length("x") / 4).orderBy("o").collect()]).reshape(-1, 2)
    within = int((np.cumsum(sizes[:, 1]) <= features_most).sum())
    rows = known.orderBy("o").limit(within).collect() if within else []
    n_grades = top + 1
    if rows:
        weight, cut = fit([np.frombuffer(r.x, dtype="<i4") for r in rows], np.array([r.g for r in rows]), n_grades)
    else:
        weight, cut = np.zeros(1 << BITS, dtype=np.float32), np.full(n_grades - 1, np.inf)
    shared = spark.sparkContext.broadcast((weight, cut))

    def run(batches):
        weight, cut = shared.value
        known = Weights(weight)
        for batch in batches:
            expected, tail = [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                if not words:
                    expected.append(0.0)
                    tail.append(0.0)
                    continue
                each = set(words)
                own = [known[w] for w in each]
                whole = text_slots(t, words, len(each))
                n = len(whole) + sum(k for _, k in own)
                s = (sum(x for x, _ in own) + float(weight[whole].sum())) / np.sqrt(np.log2(n + 2))
                above = 1 / (1 + np.exp(np.clip(cut - s, -50, 50)))  # P(grade > k)
                expected.append(float(above.sum()))
                tail.append(float(above[top - 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=["doc_id", "expected_grade", "p_top"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, p_top double")
    return scored.withColumn("kept", F.col("p_top") >= at_least)
