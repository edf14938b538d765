"""Byte-level BPE by forced boundaries.

Two bytes that stand side by side in no token of the vocabulary can't end up in
one token, so between them is a certain cut. Cuts are taken where they also
leave the splitting into words as it is: before white space, between two ASCII
letters, and between an ASCII letter and ASCII punctuation. The fragments are
encoded independently, each different one once for a worker, and the ids are
concatenated. A special token's text counts as a token, so it is never cut.

Edge cases: null and empty texts have no ids and decode to the empty text; a
text without a certain cut is one fragment; ids that don't form UTF-8 decode
with U+FFFD as the library does.
"""

from __future__ import annotations

import json
import os
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fragments that a worker keeps, and the longest one it keeps.
CACHE, LONGEST = 100_000, 200


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves,
    the others, in order, as U+0100 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = byte_of_char()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    every = {**spec["model"]["vocab"], **added}
    out = [b""] * (max(every.values()) + 1)
    for token, i in every.items():
        out[i] = token.encode() if token in added else bytes(chars[c] for c in token)
    return out


@lru_cache(maxsize=4)
def cut_table(path: str) -> np.ndarray:
    """For first byte * 256 + second byte, whether a cut between them is certain and safe."""
    joined = np.zeros(65536, dtype=bool)
    for token in token_bytes(path):
        b = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
        joined[b[:-1] * 256 + b[1:]] = True
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    letter = np.zeros(256, dtype=bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    point = np.zeros(256, dtype=bool)
    point[33:127] = True
    point &= ~letter
    point[48:58] = False
    safe = space[None, :] | (letter[:, None] & (letter | point)[None, :])
    return safe.ravel() & ~joined


def fragments(raw: bytes, cuts: np.ndarray) -> list[bytes]:
    if len(raw) < 2:
        return [raw] if raw else []
    b = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(cuts[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
    ends = at.tolist()
    return [raw[i:j] for i, j in zip([0, *ends], [*ends, len(raw)], strict=True)]


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> tuple[dict[bytes, int], list[int]]:
    """Rank of each token's bytes in merging order (bytes first), and the id of each rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    chars = byte_of_char()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [*chars, *(a + b for a, b in pairs)]
    ranks = {bytes(chars[c] for c in token): k for k, token in enumerate(order)}
    return ranks, [model["vocab"][token] for token in order]


def special_tokens(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        return [t["content"].encode() for t in json.load(f)["added_tokens"]]


class Fragments(dict):
    """Ids of fragments as little-endian int32 bytes, worked out when first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        ranks, ids = merge_ranks(path)
        self.ids = [int(i).to_bytes(4, "little") for i in ids]
        quick = tiktoken.Encoding("fragments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece, self.quick = quick._core_bpe.encode_single_piece, quick.encode_ordinary
        self.path, self.special = path, special_tokens(path)

    @cached_property
    def model(self):
        """The library's tokenizer, held by workers that meet a special token only."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.no_truncation()
        model.no_padding()
        return model

    def __missing__(self, fragment: bytes) -> bytes:
        text = fragment.decode()
        if text.removeprefix(" ").isalpha():  # a word: nothing to split
            out = b"".join([self.ids[k] for k in self.piece(fragment)])
        elif any(s in fragment for s in self.special):
            out = np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()
        else:
            out = b"".join([self.ids[k] for k in self.quick(text)])
        if len(fragment) <= LONGEST:
            if len(self) > CACHE:
                self.clear()
            self[fragment] = out
        return out


class Encoder:
    def __init__(self, path: str):
        self.cuts = cut_table(path)
        self.known = Fragments(path)
        merge_ranks.cache_clear()  # tiktoken holds them from here on

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        of = self.known.__getitem__
        return [b"".join(map(of, fragments(t, self.cuts))) if t else b"" for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _lists(values: list[bytes]) -> pa.Array:
    sizes = np.array([0, *(len(v) // 4 for v in values)], dtype=np.int64)
    flat = np.frombuffer(b"".join(values), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids array<int>."""
    path = vocabulary or default_vocabulary()
    schema = T.StructType([f for f in docs.schema if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                kept = [i for i, n in enumerate(part.schema.names) if n != ids]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), _lists(code.encode(texts))],
                    names=[*(part.schema.names[i] for i in kept), ids],
                )

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column out of the texts its ids stand for."""
    path = vocabulary or default_vocabulary()
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.StringType())])

    def run(batches):
        table = pa.array(token_bytes(path), pa.binary())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column(part.schema.get_field_index(ids))
                ends = np.cumsum([0, *(x or 0 for x in lists.value_lengths().to_pylist())])
                taken = table.take(lists.flatten())
                at = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset :][: len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int32)
                data = (taken.buffers()[2] or pa.py_buffer(b"")) if len(taken) else pa.py_buffer(b"")
                raw = memoryview(data)
                texts = [bytes(raw[at[i] : at[j]]).decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)]
                kept = [i for i, n in enumerate(part.schema.names) if n != out]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), pa.array(texts, pa.string())],
                    names=[*(part.schema.names[i] for i in kept), out],
                )

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    coded = encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    return decode(coded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
