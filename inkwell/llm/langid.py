"""Language identification by a string kernel.

The kernel of two texts counts the byte n-grams (n = 1 to 3, lower-cased) that
are present in both, weighted by n (blended spectrum), over the n-grams of the
landmark texts, and is normalised to 1 for a text with itself. Nystrom: with
the kernel matrix M of the landmarks, M^(-1/2) turns a row of kernels to the
landmarks into features; one-versus-rest ridge regression on these gives a
score for each language. Both steps fold into one matrix, so a batch is scored
by presence @ landmarks @ weights.

The fit uses a bounded sample: ``per_language`` landmarks of each language, cut
at ``landmark_chars`` characters, and ``sample`` labelled texts (at most four
rows an id on average where ids repeat), both taken in the order of a hash of
doc_id, and of ``languages`` languages at most that is, those whose first rows
come first. Every text is scored whole, however long.

Edge cases: a null text or one without a letter (\\p{L}) is ``und`` with score
0; rows without lang train nothing; without any training row everything is
``und``; ties go to the language that sorts first; rows that repeat an id are
scored each for itself; columns besides doc_id, text and lang are not looked at,
so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_side

WEIGHTS = (0.5, 1.0, 2.0)  # of n = 1, 2, 3
RIDGE = 1e-2
FLOOR = 1e-6


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of a text as numbers: n = 1 below 2^8, n = 2 from 2^16, n = 3 from 2^24."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:] if len(b) > 2 else two[:0]
    return np.concatenate([b, two + (1 << 16), three + (1 << 24)])


class Kernel:
    def __init__(self, landmarks: list[str]):
        own = [np.unique(gram_codes(t)) for t in landmarks]
        self.grams = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.int32)
        self.weight = np.select([self.grams < 1 << 16, self.grams < 1 << 24], WEIGHTS[:2], WEIGHTS[2]).astype(np.float32)
        there = np.zeros((len(self.grams), len(own)), dtype=np.float32)
        for k, codes in enumerate(own):
            there[np.searchsorted(self.grams, codes), k] = 1
        self.norm = np.sqrt(self.weight @ there) if own else np.zeros(0)
        self.landmarks = there * self.weight[:, None] / self.norm
        self.matrix = (there / self.norm).T @ self.landmarks
        # Where a gram is among the known ones, len(grams) if it is not: tables by one and two bytes, and for
        # three bytes a table row for each pair of first bytes that a known gram has.
        n, known = len(self.grams), np.arange(len(self.grams), dtype=np.int32)
        two, three = self.grams >> 16 == 1, self.grams >= 1 << 24
        self.one = np.full(1 << 8, n, dtype=np.int32)
        self.one[self.grams[self.grams < 1 << 16]] = known[self.grams < 1 << 16]
        self.two = np.full(1 << 16, n, dtype=np.int32)
        self.two[self.grams[two] - (1 << 16)] = known[two]
        head = (self.grams[three] - (1 << 24)) >> 8
        heads = np.unique(head)
        self.head = np.full(1 << 16, len(heads), dtype=np.int32)
        self.head[heads] = np.arange(len(heads))
        self.three = np.full((len(heads) + 1, 1 << 8), n, dtype=np.int32)
        self.three[self.head[head], self.grams[three] & 255] = known[three]

    def slots(self, text: str) -> np.ndarray:
        """Places of the n-grams of a text among the known ones."""
        b = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
        two = (b[:-1] << 8) | b[1:]
        return np.concatenate([self.one[b], self.two[two], self.three[self.head[two[:-1]], b[2:]] if len(b) > 2 else b[:0]])

    def rows(self, texts: list[str]) -> np.ndarray:
        """Kernels of the texts to the landmarks."""
        n = len(self.grams)
        there = np.zeros((len(texts), n + 1), dtype=np.float32)
        for k, text in enumerate(texts):
            there[k, self.slots(text)] = 1
        there = there[:, :n]
        size = np.sqrt(there @ self.weight)
        return (there @ self.landmarks) / np.maximum(size, 1e-9)[:, None]


def fit(kernel: Kernel, rows: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix from kernels to a score for each."""
    names = sorted(set(langs))
    value, vector = np.linalg.eigh(kernel.matrix.astype(np.float64))
    keep = value > FLOOR * max(value.max(), 1)
    root = vector[:, keep] / np.sqrt(value[keep])
    x = rows.astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    beta = np.linalg.solve(x.T @ x + RIDGE * len(x) * np.eye(x.shape[1]) / 100, x.T @ y)
    return names, (root @ beta).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def letters(text: Column) -> Column:
    """Whether a text has any letter; the one test for training and for ``und``."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(
    docs: DataFrame,
    per_language: int = 24,
    languages: int = 64,
    landmark_chars: int = 4000,
    sample: int = 3000,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", "lang")
    may = base.filter(F.col("lang").isNotNull() & letters(F.col("text")) & ~held_out(F.col("doc_id")))
    ids = may.select("doc_id", "lang", F.xxhash64("doc_id").alias("_o"))
    wanted = max(per_language, sample // 4)
    # A language may hold most rows: hashes are even, so its least ones are under a limit that follows from its
    # count, and ranking sees about 4 times the rows wanted, whatever the size. Languages are few thousand at most.
    limit = ids.groupBy("lang").agg((F.least(F.lit(1.0), 4.0 * wanted / F.count("*")) * 2.0**64 - 2.0**63).alias("_limit"))
    ids = ids.join(small_side(limit), "lang").filter(F.col("_o") <= F.col("_limit")).drop("_limit")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_o", "doc_id"))
    chosen = ids.withColumn("_n", nth).filter(F.col("_n") <= wanted).orderBy("_n", "lang").limit(max(sample, per_language * languages)).collect()
    heads = {r.doc_id for r in chosen if r._n <= per_language}
    train = [(r.doc_id,) for r in chosen[:sample]]
    if not chosen:
        return base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def pick(which) -> DataFrame:
        return may.join(F.broadcast(spark.createDataFrame([(i,) for i in which], f"doc_id {kind}")), "doc_id", "left_semi")

    marks = pick(heads).select("doc_id", F.substring("text", 1, landmark_chars).alias("t")).orderBy("doc_id", "t").limit(per_language * languages).collect()
    kernel = spark.sparkContext.broadcast(Kernel([r.t for r in marks]))

    def kernels(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = kernel.value.rows(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), pa.list_(pa.float32())), *part.columns[2:]], names=["lang", "k", "o", "h"])

    some = pick({i for (i,) in train}).select("lang", "text", F.xxhash64("doc_id").alias("o"), F.xxhash64("text").alias("h"))
    rows = some.mapInArrow(kernels, "lang string, k array<float>, o long, h long").orderBy("o", "h", "lang").limit(4 * sample).collect()
    names, weights = fit(kernel.value, np.array([r.k for r in rows], dtype=np.float32), [r.lang for r in rows])
    shared = spark.sparkContext.broadcast((names, weights))

    def run(batches):
        names, weights = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = part.column(2).to_pylist()
                blank = part.column(3).to_pylist()
                score = kernel.value.rows([t or "" for t in texts]) @ weights
                best = score.argmax(axis=1)
                value = np.clip((score[np.arange(len(texts)), best] + 1) / 2, 0, 1).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(["und" if e else names[i] for e, i in zip(blank, best, strict=True)], pa.string()),
                        pa.array([0.0 if e else v for e, v in zip(blank, value, strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    scored = base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", (~letters(F.col("text"))).alias("blank"))
    return scored.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
