"""Token ids in files: frequency ranks in variable-length bytes.

Ids are replaced by their rank by corpus frequency, so that common ones take a
byte. A rank takes 1 to 4 whole bytes; how many is told by two bits in separate
control bytes, four ranks to each. Decoding is numpy table lookup: the table
gives the four lengths of a control byte, sums of lengths give the places.

A token store is a folder of two Parquet tables, so any store Spark can write
to holds it, committed as Spark commits: ``ranks`` (rank, id, n) and ``tokens``
(doc_id, n_tokens, part, before, control, data), its files in the order of
doc_id. ``before`` counts the ids of the same part before the document; adding
those of earlier parts gives the global start.

Edge cases: null and empty texts have the end id alone; null ids come first;
rows that repeat an id are ordered by crc32 of their ids; an empty table gives
empty tables.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_of_char
from .common import saved, shared_dir

END_ID = 1
CACHE, LONGEST = 400_000, 100


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Ends a word in the ranks below; words that hold it take the slow way.
STOP = "\x01"
END = STOP.encode()
#: Words that lower-casing and composing leave plain, and how the vocabulary splits them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


@lru_cache(maxsize=2)
def word_ranks(path: str) -> tuple[dict[bytes, int], list[int]]:
    """Rank of each token's bytes in merging order, the end of a word as STOP, and the id of each rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    chars, end = byte_of_char(), model["end_of_word_suffix"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [*chars, *(c + end for c in chars), *(a + b for a, b in pairs)]

    def raw(token: str) -> bytes:
        body = token.removesuffix(end)
        return bytes(chars[c] for c in body) + STOP.encode() * (body != token)

    return {raw(t): k for k, t in enumerate(order)}, [model["vocab"][t] for t in order]


class Words(dict):
    """Ids of words as little-endian bytes, worked out when first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.kind = "<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4"
        ranks, ids = word_ranks(path)
        self.id_of = [np.array(i, dtype=self.kind).tobytes() for i in ids].__getitem__
        self.piece = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            out = b"".join(map(self.id_of, self.piece(word.lower() + END)))
        elif PLAIN.fullmatch(text := word.decode()) and "<|" not in text:
            out = b"".join([self.id_of(k) for part in PARTS.findall(text.lower()) for k in self.piece(part.encode() + END)])
        else:
            out = np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        if len(word) <= LONGEST:
            if len(self) > CACHE:
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Ids of texts as little-endian uint16 or uint32 bytes. The vocabulary
    drops white space and joins nothing across it, so words are encoded on
    their own, each different one once while a worker keeps it."""

    def __init__(self, path: str):
        self.known = Words(path)
        self.kind = self.known.kind

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        of, end = self.known.__getitem__, np.array([END_ID], dtype=self.kind).tobytes()
        return [b"".join(map(of, t.split())) + end if t else end for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _spots(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of such sizes, each padded to whole groups of four: where each number goes, and where each list's groups end."""
    groups = -(-sizes // 4)
    shift = np.cumsum(4 * groups) - 4 * groups - (np.cumsum(sizes) - sizes)
    return np.arange(int(sizes.sum())) + np.repeat(shift, sizes), np.cumsum(groups)


def pack(ranks: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control bytes and data bytes of each of the lists of numbers that stand one after another."""
    r = ranks.astype("<u4")
    more = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    spot, ends = _spots(sizes)
    four = np.zeros(4 * int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    four[spot] = more
    four = four.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]].tobytes()
    until = np.concatenate([[0], np.cumsum(more, dtype=np.int64) + np.arange(1, len(more) + 1)])[np.cumsum(sizes)]
    return [(control[i:j], data[k:m]) for i, j, k, m in zip([0, *ends.tolist()], ends.tolist(), [0, *until.tolist()], until.tolist(), strict=False)]


#: The lengths of the four numbers that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all lists, from their control and data bytes one after another."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[_spots(sizes)[0]]
    start = np.cumsum(size) - size
    b = np.frombuffer(data, dtype=np.uint8)
    out = b[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        has = np.flatnonzero(size > k)
        out[has] |= b[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches):
        code = encoder(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = code.encode(part.column(1).cast(pa.binary()).to_pylist())
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), crc, pa.array(ids, pa.binary())], names=["doc_id", "crc", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, crc long, ids binary")


def frequencies(tokens: DataFrame, kind: str) -> DataFrame:
    """id, n of all rows. Each task sums what it has read: a row for each id at most."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = np.bincount(np.frombuffer(x, dtype=kind))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), dtype=np.int64)])
                total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the token store of docs (doc_id, text) to the folder path."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    kind = encoder(vocabulary).kind
    tokens = saved(tokenized(docs, vocabulary), "ids")
    # As many rows as the vocabulary has ids at most: one partition and the driver can hold them.
    counted = sorted(frequencies(tokens, kind).collect(), key=lambda r: (-r.n, r.id))
    ranked = [(k, r.id, r.n) for k, r in enumerate(counted)]
    spark.createDataFrame(ranked, "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max((r[1] for r in ranked), default=0) + 1, dtype=np.uint32)
    for k, i, _ in ranked:
        rank_of[i] = k
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        rank, before, part = shared.value, 0, TaskContext.get().partitionId()
        for batch in (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256)):
            own = batch.column(1).to_pylist()
            n = np.array([len(x) for x in own], dtype=np.int64) // np.dtype(kind).itemsize
            control, data = zip(*pack(rank[np.frombuffer(b"".join(own), dtype=kind)], n), strict=True)
            b = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array([part] * len(n), pa.int32()), pa.array(b), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                names=["doc_id", "n_tokens", "part", "before", "control", "data"],
            )

    kept = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, part int, before long, control binary, data binary"
    (
        tokens.repartitionByRange(F.asc_nulls_first("doc_id"), "crc")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "crc")
        .select("doc_id", "ids")
        .mapInArrow(run, kept)
        .write.option("compression", "none")
        .parquet(f"{path}/tokens")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids array<int> of a token store."""
    coded = spark.read.parquet(f"{path}/tokens")
    ranked = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()  # the vocabulary at most
    id_of = np.zeros(max((r.rank for r in ranked), default=-1) + 1, dtype=np.int32)
    for r in ranked:
        id_of[r.rank] = r.id
    shared = spark.sparkContext.broadcast(id_of)
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row for each part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))

    def run(batches):
        table = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                doc, start, n, control, data = batch.slice(k, 256).columns
                sizes = n.to_numpy()
                flat = table[unpack(b"".join(control.to_pylist()), b"".join(data.to_pylist()), sizes)]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([doc, start, n, ids], names=["doc_id", "start", "n_tokens", "ids"])

    return (
        coded.join(F.broadcast(starts), "part")
        .select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "control", "data")
        .mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids array<int>")
    )


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the store of docs, read it back, and return start, length and crc32 of each document's ids."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/inkwell/store-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)

    def run(batches):
        for batch in batches:
            doc, start, n, ids = batch.columns
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).view("<u4")
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([doc, start, n, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    back = read(spark, path)
    return back.mapInArrow(run, f"doc_id {back.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
